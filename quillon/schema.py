"""Fixed schemas. Reading code starts from these; columns added later have defaults (migrate)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One bibliographic record.
RECORD = T.StructType(
    [T.StructField(n, T.StringType(), n not in ("oai_identifier", "source_id", "source_name", "title")) for n in ("oai_identifier", "source_id", "source_name", "title", "authors", "advisors", "abstract", "subjects")]
    + [T.StructField("year", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("type", "language", "publisher", "url", "discipline", "discipline_source", "authoritative_discipline", "datestamp")]
    + [T.StructField("harvested_at", T.TimestampType())]
)
#: What a parser makes of one harvested record.
PAYLOAD = "struct<oai_identifier:string,datestamp:string,deleted:boolean,malformed:boolean,dc:map<string,array<string>>,authoritative_discipline:string>"
#: One row a source.
CHECKPOINT = "source_id string, last_harvest_started string, last_records_seen int, last_records_kept int, last_records_deleted int"
#: Label of records that no rule classifies.
OTHER = "Autre / non classé"


def migrate(records: DataFrame) -> DataFrame:
    """records with every column of RECORD: missing ones are null; where discipline_source is missing, labels that are not OTHER
    count as given by a model, which is how tables without the column were filled."""
    if "discipline_source" not in records.columns:
        records = records.withColumn("discipline_source", F.when(F.coalesce("discipline", F.lit(OTHER)) != OTHER, "llm").otherwise("rule"))
    for field in RECORD.fields:
        if field.name not in records.columns:
            records = records.withColumn(field.name, F.lit(None).cast(field.dataType))
    return records.select(*[F.col(f.name).cast(f.dataType) for f in RECORD.fields])
