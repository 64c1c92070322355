"""The context tables as the operators' inputs, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import spread, table

#: Keyword table of the queries (a parameter of the operators).
KEYWORDS = ["Anchor", "queue", "Pressure", "glossary", "snapshot", "Messreihe", "carpeta", "dossier", "token", "pump", "folder"]
_LIST = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
#: Keywords that a text contains, in SQL.
HITS = f"list_filter({_LIST}, lambda k: contains(lower(content), lower(k)))"

#: Common table expressions: documents, and documents as memory rows.
DOCS = "docs as (select doc_id as id, text as content, source, lang, bucket, provenance, ingested_at as ts, epoch_us(ingested_at) as ts_us from documents where text is not null)"
TYPE = r"""case when lower(string_split(source, '.')[-1]) in ('csv', 'json') then 'data' when lower(string_split(source, '.')[-1]) in ('ts', 'js', 'py', 'rs', 'go', 'java', 'cpp', 'c', 'h') then 'code'
 when starts_with(ltrim(content), '|') then 'data' when contains(content, '```') or regexp_matches(content, '\b(function|const|import) ') then 'code' else 'prose' end"""
MEMORY = f"{DOCS}, memory as (select *, list_filter([bucket], lambda b: b is not null) as buckets, {HITS} as tags, {TYPE} as type from docs)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").where("text is not null"))
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang", "bucket", "provenance", F.col("ingested_at").alias("ts"), F.unix_micros("ingested_at").alias("ts_us"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.withColumns({"buckets": F.array_compact(F.array("bucket")), "tags": X.keyword_hits(F.col("content"), KEYWORDS), "type": X.molecule_type(F.col("content"), F.col("source")), "sequence": F.lit(0)})


def joined(c):  # noqa: ANN001, ANN201
    return F.array_join(c, "|")
