"""Behaviour of parsing, normalisation, classification, storage and checkpoints on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import batch_labels, classify, merge, normalize
from quillon.schema import OTHER, RECORD, migrate
from quillon.sources import oai, parse

RECORD_XML = '<record xmlns="http://www.openarchives.org/OAI/2.0/"><header{status}><identifier>oai:x:1</identifier><datestamp>2024-01-02</datestamp></header><metadata>{body}</metadata></record>'
NAMESPACES = 'xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dim="http://www.dspace.org/xmlns/dspace/dim" xmlns:u="http://naca.central.cranfield.ac.uk/ethos-oai/terms/"'


def parsed(spark, prefix, body, status=""):
    xml = RECORD_XML.format(status=status, body=body)
    return parse.parse(spark.createDataFrame([(xml,)], "xml string"), prefix).first()


@pytest.mark.parametrize("prefix", ["oai_dc", "dim", "oai_etdms", "uketd_dc", "unknown"])
def test_tombstones_of_every_dialect(spark, prefix):
    r = parsed(spark, prefix, "", ' status="deleted"')
    assert r.deleted and r.oai_identifier == "oai:x:1" and not r.malformed


def test_plain_dublin_core(spark):
    r = parsed(spark, "oai_dc", f"<oai_dc:dc {NAMESPACES}><dc:title> A title </dc:title><dc:subject>One</dc:subject><dc:subject>  </dc:subject><dc:subject>Two</dc:subject></oai_dc:dc>")
    assert r.dc == {"title": ["A title"], "subject": ["One", "Two"]} and r.authoritative_discipline is None and r.datestamp == "2024-01-02"
    assert parsed(spark, "oai_dc", "").malformed


def test_qualified_fields(spark):
    f = lambda s, e, q, t: f'<dim:field mdschema="{s}" element="{e}" qualifier="{q}">{t}</dim:field>'
    body = f("dc", "contributor", "author", "B, A") + f("dc", "contributor", "author", "D, C") + f("dc", "contributor", "editor", "No") + f("dc", "contributor", "thesisadvisor", "G, H") + f("etd", "degree", "discipline", "Biology") + f("thesis", "degree", "level", "Doctoral") + '<dim:field mdschema="dc" element="title">T</dim:field>'
    r = parsed(spark, "dim", f"<dim:dim {NAMESPACES}>{body}</dim:dim>")
    assert r.dc == {"creator": ["B, A", "D, C"], "_advisor": ["G, H"], "type": ["Doctoral"], "title": ["T"]} and r.authoritative_discipline == "Biology"


def test_degree_block(spark):
    body = '<thesis xmlns="http://www.ndltd.org/standards/metadata/etdms/1.0/"><title>T</title><subjectsss>S</subjectsss><contributor role="advisor">G</contributor><contributor role="committeeMember">N</contributor><degree><name>PhD</name><level>doctoral</level><discipline>Law</discipline><grantor>U</grantor></degree></thesis>'
    r = parsed(spark, "etdms", body)
    assert r.dc == {"title": ["T"], "subject": ["S"], "_advisor": ["G"], "type": ["doctoral", "PhD"], "publisher": ["U"]} and r.authoritative_discipline == "Law"


def test_department_is_authority_whatever_the_root(spark):
    body = f"<thesis_metadata {NAMESPACES}><dc:title>T</dc:title><u:department>Physics</u:department><u:qualificationlevel>masters</u:qualificationlevel><u:institution>U</u:institution></thesis_metadata>"
    r = parsed(spark, "uketd_dc", body)
    assert r.dc == {"title": ["T"], "type": ["masters"], "publisher": ["U"]} and r.authoritative_discipline == "Physics"


def normal(spark, authority=None, **dc):
    frame = spark.createDataFrame([("oai:x:1", "2024", {k: v for k, v in dc.items()}, authority, "s", "S")], "oai_identifier string, datestamp string, dc map<string,array<string>>, authoritative_discipline string, source_id string, source_name string")
    return normalize.normalized(frame).first()


@pytest.mark.parametrize(
    ("types", "kind"),
    [(["Doctoral thesis"], "thesis"), (["Master's thesis"], "memoire"), (["info:eu-repo/semantics/masterThesis"], "memoire"), (["Thèse ou mémoire", "Mémoire de maîtrise"], "memoire"), (["Thèse"], "thesis"), (["Article"], None), (["Book"], None), (["map"], None), (["masters"], "memoire"), (["Ph.D"], "thesis")],
)
def test_kinds(spark, types, kind):
    r = normal(spark, title=["A"], type=types)
    assert r.type == kind and r.kept == (kind is not None)


def test_kind_from_text_only_without_a_type(spark):
    assert normal(spark, title=["T"], description=["A PhD dissertation"]).type == "thesis"
    assert normal(spark, title=["T"], description=["une synthese"]).type == "thesis"
    assert not normal(spark, title=["T"], type=["Article"], description=["A PhD thesis"]).kept
    assert not normal(spark, type=["Thesis"]).kept


def test_year_address_cleaning(spark):
    r = normal(spark, title=["  A &amp; B\n c "], type=["thesis"], date=["2019-05-01", "2012"], issued=["no year"], identifier=["x", "https://a.example/f.pdf", "https://a.example/p", "https://doi.org/10.1/x"], creator=["Z, Y", "  ", "X &eacute;"])
    assert (r.title, r.year, r.url, r.authors) == ("A & B c", 2012, "https://doi.org/10.1/x", "Z, Y; X é")
    r = normal(spark, "Chimie", title=["T"], type=["thesis"], subject=["One"], date=["1600"])
    assert (r.subjects, r.year, r.url, r.authoritative_discipline) == ("Chimie; One", None, "", "Chimie")
    assert normal(spark, "One", title=["T"], type=["thesis"], subject=["One"]).subjects == "One"


def label(spark, **record):
    names = ("title", "subjects", "abstract", "publisher", "authoritative_discipline")
    row = tuple(record.get(n) for n in names)
    r = classify.classified(spark.createDataFrame([row], ", ".join(f"{n} string" for n in names)), stored=False).first()
    return r.discipline, r.discipline_source


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ({"title": "Didactique des mathématiques"}, ("Didactique", "rule")),
        ({"title": "Étude en écologie microbienne"}, ("Écologie", "rule")),
        ({}, (OTHER, "none")),
        ({"subjects": "Sciences de l'éducation et psychologie scolaire"}, ("Sciences de l'éducation", "rule")),
        ({"subjects": "econometrics", "abstract": "éducation"}, ("Économie", "rule")),
        ({"abstract": "on education"}, (OTHER, "none")),
        ({"subjects": "machine learning", "abstract": "learning strategies"}, ("Intelligence artificielle & apprentissage automatique", "rule")),
        ({"abstract": "political science"}, ("Science politique", "rule_abstract")),
        ({"authoritative_discipline": "Chimie organique", "title": "droit"}, ("Chimie", "auth")),
        ({"authoritative_discipline": "no such", "title": "droit"}, ("Droit", "rule")),
        ({"title": "a flaw in it"}, ("Droit", "rule")),
        ({"title": "socio-economique"}, ("Économie", "rule")),
        ({"title": "mathematiques"}, ("Mathématiques", "rule")),
        ({"title": "Étude en psychologie cognitive"}, ("Psychologie", "rule")),
        ({"title": "La participation citoyenne au départ", "subjects": "participation"}, (OTHER, "none")),
        ({"title": "A study of curriculum design"}, ("Sciences de l'éducation", "rule")),
        ({"subjects": "Literacy intervention; Reading"}, ("Sciences de l'éducation", "rule")),
        ({"subjects": "English language -- Study and teaching"}, ("Sciences de l'éducation", "rule")),
        ({"title": "Mental health interventions"}, ("Psychologie", "rule")),
        ({"subjects": "Rural sociology"}, ("Sociologie", "rule")),
        ({"subjects": "Zoology; Marine biology"}, ("Biologie", "rule")),
        ({"title": "Organic chemistry of natural products"}, ("Chimie", "rule")),
        ({"title": "A clinical oncology trial"}, ("Médecine", "rule")),
        ({"subjects": "Microéconomie; Économétrie; Épargne"}, ("Économie", "rule")),
        ({"title": "L'éducation préscolaire au Québec"}, ("Sciences de l'éducation", "rule")),
        ({"subjects": "Génie civil; Structures"}, ("Génie civil", "rule")),
        ({"title": "Optimisation en génie électrique"}, ("Génie électrique", "rule")),
        ({"subjects": "Pharmacologie; Drug delivery"}, ("Sciences pharmaceutiques", "rule")),
        ({"title": "Neuroimagerie des circuits neuronaux"}, ("Neurosciences", "rule")),
        ({"subjects": "Études féministes; Gender studies"}, ("Études féministes / études de genre", "rule")),
        ({"title": "Souveraineté des Premières Nations au Canada"}, ("Études autochtones", "rule")),
        ({"subjects": "Démographie; Fécondité"}, ("Démographie", "rule")),
        ({"title": "Étude en traductologie comparée"}, ("Traduction", "rule")),
        ({"subjects": "Études cinématographiques; Film theory"}, ("Études cinématographiques", "rule")),
        ({"subjects": "Archéologie préhistorique"}, ("Archéologie", "rule")),
        ({"subjects": "Finance; Investissement"}, ("Finance", "rule")),
        ({"title": "Apprentissage profond pour la vision par ordinateur"}, ("Intelligence artificielle & apprentissage automatique", "rule")),
        ({"title": "Modélisation du changement climatique"}, ("Climatologie", "rule")),
        ({"subjects": "Génétique humaine; Hérédité"}, ("Génétique", "rule")),
    ],
)
def test_labels(spark, record, want):
    assert label(spark, **record) == want


def test_all_labels_can_be_found(spark):
    """A record whose source names a label as its discipline gets it, unless an earlier rule's keyword stands in the name."""
    names = [n for n, _ in classify.CORE_RULES]
    assert len(names) == len(set(names)) == 74 and sum(len(k) for _, k in classify.CORE_RULES) + len(names) < 300
    got = {n: label(spark, authoritative_discipline=n)[0] for n in names[:40:3]}
    assert all(v in names for v in got.values()) and sum(k == v for k, v in got.items()) >= len(got) - 1


ROW = "oai_identifier string, title string, discipline string, discipline_source string, harvested_at string"


@pytest.mark.parametrize(
    ("old", "new", "kept"),
    [("rule", "rule", "new"), ("llm", "rule", "old"), ("manual", "rule", "old"), ("rule_abstract", "rule", "old"), ("auth", "llm", "old"), ("llm", "auth", "new"), ("rule", "rule_abstract", "new"), ("auth", "manual", "new")],
)
def test_upsert_precedence(spark, old, new, kept):
    a = spark.createDataFrame([("k", "t1", "old", old, "first")], ROW)
    b = spark.createDataFrame([("k", "t2", "new", new, "second"), ("m", "t", "x", "rule", "second")], ROW)
    rows = {r.oai_identifier: r for r in merge.upserted(a, b).collect()}
    assert (rows["k"].title, rows["k"].discipline, rows["k"].harvested_at) == ("t2", kept, "first")
    assert rows["m"].discipline == "x"
    again = {tuple(r) for r in merge.upserted(merge.upserted(a, b), b).collect()}
    assert again == {tuple(r) for r in merge.upserted(a, b).collect()}


def test_tombstones_checkpoints_and_migration(spark):
    a = spark.createDataFrame([("k", "t1", "old", "rule", "first")], ROW)
    assert merge.without(a, a.select("oai_identifier")).count() == 0
    assert merge.without(a, spark.createDataFrame([("z",)], "oai_identifier string")).count() == 1
    state = spark.createDataFrame([("a", "1"), ("b", "1")], "source_id string, last_harvest_started string")
    runs = spark.createDataFrame([("a", "2", True), ("b", "2", False), ("c", "2", True)], "source_id string, last_harvest_started string, succeeded boolean")
    assert {tuple(r) for r in merge.checkpointed(state, runs).collect()} == {("a", "2"), ("b", "1"), ("c", "2")}
    sources = spark.createDataFrame([("a",), ("z",)], "source_id string")
    assert {tuple(r) for r in merge.resume_from(sources, state).collect()} == {("a", "1"), ("z", None)}
    assert {r.from_date for r in merge.resume_from(sources, state, full=True).collect()} == {None}
    old = migrate(spark.createDataFrame([("k", "Droit"), ("m", OTHER)], "oai_identifier string, discipline string"))
    assert old.columns == RECORD.names and {r.discipline_source for r in old.collect()} == {"llm", "rule"}


def test_folding_equals_applying_in_order(spark):
    import random

    rnd = random.Random(2)
    feed = [(rnd.randrange(4), i, rnd.choice(["rule", "rule_abstract", "llm", "auth", "manual"]), f"d{i}", rnd.random() < 0.15) for i in range(60)]
    state: dict = {}
    for k, at, source, lab, gone in feed:
        if gone:
            state.pop(k, None)
            continue
        old = state.get(k)
        better = old is None or merge.RANKS.get(source, 0) >= merge.RANKS.get(old[2], 0)
        state[k] = (at, lab if better else old[1], source if better else old[2])
    frame = spark.createDataFrame(feed, "k int, at int, source string, label string, gone boolean").withColumn("value", F.col("at"))
    got = {r.k: (r.value, r.label, r.source) for r in merge.folded(frame, "k", ["at"], "source", "gone", ["value"], "label").collect()}
    assert got == state


def test_batch_answers_are_read_tolerantly(spark):
    lines = ['{"key":"a","response":{"candidates":[{"content":{"parts":[{"text":"{\\"discipline\\": \\"Droit\\"}"}]}}]}}', "{broken", '{"key":"b","response":{"candidates":[{"content":{"parts":[{"text":"oops"}]}}]}}', ""]
    got = batch_labels.answers(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("a", "Droit")]
    rows = spark.createDataFrame([("a", "t", "x", "", "", "", "", 0)], "oai_identifier string, title string, authors string, abstract string, subjects string, publisher string, source_name string, year int")
    asked = batch_labels.answered(rows, ["Droit"], lambda prompts: ["Droit" if "Titre : t" in p else "?" for p in prompts]).collect()
    assert [tuple(r) for r in asked] == [("a", "Droit")]


PAGE = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{records}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>'
ERROR = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><error code="{code}">x</error></OAI-PMH>'
ONE = "<record><header><identifier>oai:{i}</identifier></header></record>"


def test_harvest_pages_retries_and_skips():
    asked = []

    def fetch(url, timeout):
        asked.append((url, timeout))
        if len(asked) == 1:
            raise TimeoutError
        if "resumptionToken=t%3A5" in url:
            return ERROR.format(code="cannotDisseminateFormat").encode()
        if "resumptionToken=t%3A6" in url:
            return PAGE.format(records=ONE.format(i=3), token="").encode()
        return PAGE.format(records=ONE.format(i=1) + ONE.format(i=2), token="t:5").encode()

    h = oai.Harvest({"id": "a", "base_url": "http://r.example/oai", "set": "th"}, fetch, 0, "2024-01-01")
    pages = list(h.pages())
    assert [len(p) for p, _ in pages] == [2, 1] and h.skipped == 1
    assert asked[0][1] == 120 and asked[1][1] == 240 and "from=2024-01-01" in asked[0][0] and "set=th" in asked[0][0]
    assert oai.bumped("x:9", 2) == "x:11" and oai.bumped("x") is None
    none = oai.Harvest({"id": "a", "base_url": "http://r"}, lambda u, t: ERROR.format(code="noRecordsMatch").encode(), 0)
    assert list(none.pages()) == []
    bad = oai.Harvest({"id": "a", "base_url": "http://r"}, lambda u, t: ERROR.format(code="badArgument").encode(), 0)
    with pytest.raises(RuntimeError):
        list(bad.pages())
    assert oai.get_record({"base_url": "http://r"}, "x", lambda u, t: b"<broken") is None


def test_data_source_batch_and_stream(spark, tmp_path):
    import json

    for k, token in enumerate(("1", "")):
        (tmp_path / f"{k}.xml").write_text(PAGE.format(records=ONE.format(i=k), token=token))
    spark.dataSource.register(oai.OaiSource)
    sources = json.dumps([{"id": "a", "base_url": f"dir:{tmp_path}"}, {"id": "b", "base_url": f"dir:{tmp_path}"}])
    got = spark.read.format("oai").options(sources=sources, delay="0").load()
    assert got.count() == 4 and {r.source_id for r in got.collect()} == {"a", "b"}
    assert spark.read.format("oai").options(sources=sources, delay="0", only="b", max_records="1").load().count() == 1
    name = f"harvest_{tmp_path.name}".replace("-", "_")
    query = spark.readStream.format("oai").options(sources=sources).load().writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert spark.table(name).count() == 4
    finally:
        query.stop()


EMPTY = '<record xmlns="http://www.openarchives.org/OAI/2.0/"><header><identifier>oai:x:{n}</identifier></header><metadata>{body}</metadata></record>'


def test_pages_are_fetched_again():
    calls, waits, warmed = [], [], []

    def fetch(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("refused")
        return b"page"

    again = oai.Retrying(fetch, 3, 2.0, lambda: warmed.append(1), waits.append)
    assert again("u", 1) == b"page" and waits == [2.0, 4.0] and len(warmed) == 2
    calls[:] = []
    with pytest.raises(OSError):
        oai.Retrying(fetch, 2, 0, None, waits.append)("u", 1)


def test_empty_records_are_asked_for_in_plain_form():
    source = {"id": "a", "base_url": "http://r"}
    answer = f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><GetRecord>{EMPTY.format(n=1, body="<dc>T</dc>")}</GetRecord></OAI-PMH>'.encode()
    full, empty = EMPTY.format(n=1, body="<dc>T</dc>"), EMPTY.format(n=1, body="<dc> </dc>")
    assert oai.filled(source, full, lambda u, t: b"never") == (full, False)
    xml, plain = oai.filled(source, empty, lambda u, t: answer)
    assert plain and "T" in xml
    assert oai.filled(source, empty, lambda u, t: b"<broken") == (empty, False)
    gone = empty.replace("<header>", '<header status="deleted">')
    assert oai.filled(source, gone, lambda u, t: answer) == (gone, False)


def test_the_life_of_a_batch(spark):
    import json

    fields = ("oai_identifier", "title", "authors", "abstract", "subjects", "publisher", "source_name", "discipline", "discipline_source")
    rows = [(f"k{i}", f"t{i}", "", "", "", "", "S", OTHER if i % 2 else "Droit", "rule") for i in range(6)]
    records = spark.createDataFrame([(*r, 2000) for r in rows], ", ".join(f"{f} string" for f in fields) + ", year int")

    class Client:
        def __init__(self):
            self.lines, self.asked = [], 0

        def submit(self, lines):
            self.lines = list(lines)
            return "job"

        def state(self, name):
            self.asked += 1
            return "running" if self.asked < 3 else "succeeded"

        def answers(self, name):
            for line in self.lines:
                key = json.loads(line)["key"]
                yield json.dumps({"key": key, "response": {"candidates": [{"content": {"parts": [{"text": json.dumps({"discipline": "Chimie" if key != "k1" else "no such"})}]}}]}})
            yield "{broken"

    client, waits = Client(), []
    job = batch_labels.BatchJob(client, ["Chimie", OTHER], "Label.", waits.append)
    n, first = job.preview(records, 2)
    assert n == 3 and len(first) == 2 and json.loads(first[0])["key"] == "k1"
    got = {r.oai_identifier: (r.discipline, r.discipline_source) for r in job.run(records, lambda lines: spark.createDataFrame([(x,) for x in lines], "value string"), 5).collect()}
    assert waits == [5, 5] and got["k3"] == got["k5"] == ("Chimie", "llm") and got["k1"] == (OTHER, "rule") and got["k0"] == ("Droit", "rule")
    client.state = lambda name: "failed"
    with pytest.raises(RuntimeError):
        job.poll("job")


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    from quillon.streaming import ingest

    names = "k string, at long, source string, gone boolean, v long, label string"
    table = ingest.RecordTable(spark, str(tmp_path / "t"), 8)
    run = ingest.apply_batch(table, "k", ["at"], "source", "gone", ["v"], "label")
    run(spark.createDataFrame([(f"k{i}", 1, "rule", False, i, "a") for i in range(40)], names), 0)
    few = spark.createDataFrame([("k3", 2, "rule", False, 99, "b"), ("k4", 2, "rule", True, 0, "b")], names)
    for _ in range(2):  # a batch that is replayed is applied once in effect
        run(few, 1)
        rows = {r.k: r.v for r in table.read().collect()}
        assert len(rows) == 39 and rows["k3"] == 99 and "k4" not in rows and rows["k39"] == 39
    touched = {n for n in table._names(f"{table.path}/v=2") if n.startswith("bucket=")}
    assert 1 <= len(touched) <= 2
    run(spark.createDataFrame([(f"k{i}", 3, "rule", True, i, "a") for i in range(39)], names), 2)
    assert [r.k for r in table.read().collect()] == ["k39"]  # buckets that lost all their rows stay empty
