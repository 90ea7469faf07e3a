"""Three-pass keyword classification into disciplines, generated as CASE expressions, and batch reclassification.

The rules are data: an ordered list of (label, keywords), read from a YAML or JSON file (load_rules), the first match wins. CORE_RULES
has all labels in their order with their main keywords; a deployment brings its own file, whose size is not limited.
"""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.schema import OTHER

Rules = list[tuple[str, list[str]]]

#: Labels and keywords whose order and text decide results; folded, without accents. "=" is the label itself, its parts
#: at "&" and "/" apart.
CORE_RULES: Rules = [
    ("Didactique", ["=", "didactic"]),
    ("Sciences de l'éducation", ["=", "education", "pedagogie", "enseignement", "teaching", "curriculum", "literacy", "learning strategies", "online learning"]),
    ("Neurosciences", ["=", "neuroscience", "neuroimagerie", "circuits neuronaux"]),
    ("Psychologie", ["=", "psychology", "cognitive science", "mental health"]),
    ("Démographie", ["=", "demography"]),
    ("Études féministes / études de genre", ["=", "gender "]),
    ("Études autochtones", ["=", "indigenous studies", "premieres nations"]),
    ("Études québécoises", ["=", "quebec studies"]),
    ("Sociologie", ["=", "sociology", "socio-"]),
    ("Anthropologie", ["=", "anthropology"]),
    ("Archéologie", ["=", "archaeology"]),
    ("Science politique", ["=", "political science"]),
    ("Économie", ["=", "economics", "econometrie", "econometrics", "economique"]),
    ("Relations industrielles", ["=", "industrial relations"]),
    ("Travail social", ["=", "social work"]),
    ("Criminologie", ["=", "criminology"]),
    ("Droit", ["=", "law ", "juridique", " legal"]),
    ("Histoire", ["=", " history", "historical"]),
    ("Géographie", ["=", "geography"]),
    ("Philosophie", ["=", "philosophy", "ethics"]),
    ("Études religieuses", ["theologie", "theology", "=", "religious studies"]),
    ("Linguistique", ["=", "linguistics"]),
    ("Traduction", ["=", "traductologie", "translation"]),
    ("Littérature", ["=", "literature", "literary"]),
    ("Études cinématographiques", ["=", "film studies", "film theory"]),
    ("Communication", ["=", "media studies", "journalisme"]),
    ("Musique", ["=", "music"]),
    ("Théâtre / arts de la scène", ["=", "theater"]),
    ("Danse", ["=", "dance"]),
    ("Design", ["design industriel", "industrial design"]),
    ("Arts visuels et médiatiques", ["arts visuels", "visual arts", "design"]),
    ("Sciences pharmaceutiques", ["=", "pharmacology", "pharmacologie", "drug delivery"]),
    ("Sciences infirmières", ["=", "nursing"]),
    ("Santé publique", ["=", "public health", "epidemiology"]),
    ("Kinésiologie & sciences de l'activité physique", ["=", "kinesiology"]),
    ("Nutrition", ["="]),
    ("Sciences de la réadaptation", ["readaptation", "rehabilitation"]),
    ("Médecine dentaire", ["=", "dentistry"]),
    ("Médecine vétérinaire", ["=", "veterinary"]),
    ("Médecine", ["=", "medicine", "medical", "clinical", "oncology"]),
    ("Biologie cellulaire et moléculaire", ["molecular biology", "biochimie", "biochemistry"]),
    ("Génétique", ["=", "genetics"]),
    ("Microbiologie", ["=", "microbiology"]),
    ("Biotechnologie", ["=", "biotechnology", "bioinformatics"]),
    ("Biologie", ["=", "biology"]),
    ("Écologie", ["=", "ecology"]),
    ("Foresterie", ["=", "forestry"]),
    ("Sciences de la Terre", ["=", "geology", "geologie"]),
    ("Climatologie", ["=", "climate", "changement climatique"]),
    ("Hydrologie & océanographie", ["=", "hydrology"]),
    ("Sciences de l'environnement", ["environnement", "environmental"]),
    ("Astronomie & astrophysique", [" astro", "astronomy", "="]),
    ("Chimie", ["=", "chemistry"]),
    ("Physique", ["=", "physics", "quantum"]),
    ("Statistique", ["=", "statistics"]),
    ("Mathématiques", ["mathematique", "mathematics", "topology", "geometry"]),
    ("Intelligence artificielle & apprentissage automatique", ["=", "machine learning", "deep learning", "apprentissage profond"]),
    ("Informatique", ["=", "computer science", "algorithms"]),
    ("Génie civil", ["=", "civil engineering"]),
    ("Génie mécanique", ["=", "mechanical engineering"]),
    ("Génie électrique", ["=", "electrical engineering"]),
    ("Génie chimique", ["=", "chemical engineering"]),
    ("Génie biomédical", ["=", "biomedical engineering"]),
    ("Génie aérospatial", ["=", "aerospace"]),
    ("Génie industriel", ["=", "industrial engineering"]),
    ("Science des matériaux", ["=", "materials science"]),
    ("Génie", ["genie ", "engineering"]),
    ("Urbanisme & études urbaines", ["=", "urban planning"]),
    ("Architecture", ["="]),
    ("Comptabilité", ["=", "accounting"]),
    ("Finance", ["=", "financial"]),
    ("Marketing", ["="]),
    ("Ressources humaines", ["=", "human resources"]),
    ("Administration & gestion", ["=", "management"]),
]
#: Keywords too general for abstracts.
BROAD = frozenset(
    (
        "education", "art", "history", "law", "design", "litterature", "literature", "literary", "topologie", "topology", "geometrie", "geometry", "algebrique", "learning strategies", "online learning",
        "bioinformatics", "bioinformatique", "epidemiology", "epidemiologie", "image processing", "topic modeling", "recommendation systems",
    )
)


def keywords_of(label: str, keywords: list[str]) -> list[str]:
    """A rule's keywords with "=" resolved."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", label.lower()) if not unicodedata.combining(c))
    return [x for k in keywords for x in (re.split(r" [&/] ", folded) if k == "=" else [k])]


def load_rules(path: str) -> Rules:
    """Rules from a file: a JSON or YAML list of {label, keywords}, or of [label, [keywords]]."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        rows = json.loads(text)
    else:
        import yaml

        rows = yaml.safe_load(text)
    return [(r["label"], list(r["keywords"])) if isinstance(r, dict) else (r[0], list(r[1])) for r in rows]


def pattern(keyword: str) -> str:
    """A keyword with a space stands anywhere; a single word needs other characters than letters around it and may end in s."""
    plain = lambda k: re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", k)
    return plain(keyword) if " " in keyword else f"(?:^|[^a-z]){plain(keyword.strip())}s?(?:[^a-z]|$)"


def kept_keywords(label: str, keywords: list[str], broad: bool = True) -> list[str]:
    return [k for k in keywords_of(label, keywords) if broad or k.strip() not in BROAD]


def first_label(blob: Column, rules: Rules, broad: bool = True) -> Column:
    """The first label with a keyword in the text. Rules are a constant array that is walked, so the code generated doesn't grow with them;
    a word is looked for as it is first, and only where it stands its expression is tried."""
    rows = [{"label": label, "k": k if " " in k else k.strip(), "p": None if " " in k else pattern(k)} for label, keywords in rules for k in kept_keywords(label, keywords, broad)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,k:string,p:string>>")
    return F.get(F.filter(table, lambda r: blob.contains(r["k"]) & (r["p"].isNull() | F.rlike(blob, r["p"]))), 0)["label"]


def classified(records: DataFrame, rules: Rules = CORE_RULES, to: str = "discipline", tag: str = "discipline_source", stored: bool = True) -> DataFrame:
    """records with their discipline and where it comes from: the source's own string ("auth"), subjects, title and publisher ("rule"),
    or the abstract without broad keywords ("rule_abstract"). What nothing matches is OTHER, tagged "none", stored as "rule"."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("")
    blobs = records.select("*", T.lower_fold(F.trim(text("authoritative_discipline"))).alias("__auth"), T.lower_fold(F.concat_ws(" ", text("subjects"), text("title"), text("publisher"))).alias("__main"), T.lower_fold(text("abstract")).alias("__abstract"))
    auth = F.when(F.col("__auth") != "", first_label(F.col("__auth"), rules))
    passes = blobs.withColumn("__a", auth).withColumn("__b", F.when(F.col("__a").isNull(), first_label(F.col("__main"), rules)))
    passes = passes.withColumn("__c", F.when(F.col("__a").isNull() & F.col("__b").isNull(), first_label(F.col("__abstract"), rules, broad=False)))
    none = "rule" if stored else "none"
    source = F.when(F.col("__a").isNotNull(), "auth").when(F.col("__b").isNotNull(), "rule").when(F.col("__c").isNotNull(), "rule_abstract").otherwise(none)
    return passes.withColumn(to, F.coalesce("__a", "__b", "__c", F.lit(OTHER))).withColumn(tag, source).drop("__auth", "__main", "__abstract", "__a", "__b", "__c")


def reclassified(records: DataFrame, rules: Rules = CORE_RULES, force: bool = False) -> DataFrame:
    """records with new_discipline, new_source and `action`: llm_to_auth, other_to_specific, reassigned, provenance or keep.

    Labels given by hand are not looked at, those given by a model only yield to the source's own, and no label falls back to OTHER.
    """
    found = classified(records, rules, "new_discipline", "new_source", stored=False)
    old = F.coalesce(F.nullif("discipline", F.lit("")), F.lit(OTHER))
    new, before, after = F.col("new_discipline"), F.coalesce("discipline_source", F.lit("rule")), F.col("new_source")
    model = before == "llm"
    action = (
        F.when((before == "manual") & F.lit(not force), "keep")
        .when(model & F.lit(not force) & (after != "auth"), "keep")
        .when(model & (after == "auth") & (old != new), "llm_to_auth")
        .when((old == OTHER) & (new != OTHER), "other_to_specific")
        .when((old != OTHER) & (new != OTHER) & (old != new), "reassigned")
        .when((old == new) & (after != before) & (after != "none"), "provenance")
        .otherwise("keep")
    )
    return found.withColumn("action", action)


def applied(reclassified_records: DataFrame) -> DataFrame:
    change = F.col("action") != "keep"
    return reclassified_records.withColumn("discipline", F.when(change, F.col("new_discipline")).otherwise(F.col("discipline"))).withColumn("discipline_source", F.when(change, F.col("new_source")).otherwise(F.col("discipline_source"))).drop("new_discipline", "new_source", "action")


def transitions(reclassified_records: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent changes of label."""
    moved = F.col("action").isin("llm_to_auth", "other_to_specific", "reassigned")
    old = F.coalesce(F.nullif("discipline", F.lit("")), F.lit(OTHER))
    # counted first and filtered after: a filter on the action would make the optimiser repeat the rules below the projection
    counts = reclassified_records.groupBy(old.alias("from_label"), F.col("new_discipline").alias("to_label")).agg(F.count_if(moved).alias("n")).where("n > 0")
    return counts.orderBy(F.desc("n"), "from_label", "to_label").limit(most)


def provenance_mix(records: DataFrame) -> DataFrame:
    """(discipline_source, n, share)."""
    total = records.agg(F.count("*").alias("t"))
    return records.groupBy("discipline_source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("discipline_source", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))
