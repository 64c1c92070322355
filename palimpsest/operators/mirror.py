"""Mirror export: every source's rows as Markdown bundles below a path of bucket and tags."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .organize import QUARANTINE_TAGS, _list

BUNDLE = 100


def mirror_dir() -> Column:
    """``@bucket/#tag/#tag``: tags in order, without the bucket and the inbox; quarantined rows apart."""
    tags, buckets = _list("tags"), _list("buckets")
    first = F.coalesce(F.get(buckets, F.lit(0)), F.lit("general"))
    quarantined = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in QUARANTINE_TAGS]))
    bucket = F.when(F.coalesce(quarantined, F.lit(False)), "quarantine").when(first.isin("", "unknown"), "general").otherwise(first)
    rest = F.array_sort(F.filter(F.array_distinct(tags), lambda t: (t != bucket) & (t != "inbox")))
    named = F.transform(rest, lambda t: F.concat(F.lit("#"), X.safe_name(F.regexp_replace(t, "^#", ""))))
    return F.concat_ws("/", F.concat(F.lit("@"), X.safe_name(bucket)), F.when(F.size(named) > 0, F.array_join(named, "/")).otherwise("#_untagged"))


def bundles(memory: DataFrame, size: int = BUNDLE) -> DataFrame:
    """Rows with their folder, part and file name; parts of ``size`` rows in order of sequence and time."""
    df = memory.withColumns({"dir": mirror_dir(), "source": F.coalesce("source", F.lit(""))})
    w = Window.partitionBy("dir", "source")
    df = df.withColumns({"rn": F.row_number().over(w.orderBy("sequence", "ts", "id")), "n": F.count("*").over(w)})
    part = F.floor((F.col("rn") - 1) / size) + 1
    base = F.lower(X.safe_name(F.when(F.col("source").isin("", "unknown"), "daily_archive").otherwise(F.element_at(F.split("source", "/"), -1))))
    digest = F.substring(F.md5(F.when(F.col("source") == "", "orphan").otherwise(F.col("source"))), 1, 8)
    name = F.concat(base, F.lit("_"), digest, F.when(F.col("n") > size, F.concat(F.lit("_part"), part)).otherwise(""), F.lit(".md"))
    return df.withColumns({"part": part, "file": name}).drop("rn")


def documents(bundled: DataFrame) -> DataFrame:
    """(dir, file, markdown): one text per bundle, of at most the bundle's rows."""
    title = F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1)
    head = F.when(title != "", title).otherwise(F.regexp_extract(F.trim(F.substring("content", 1, 50)), r"^([^\n]*)", 1))
    short = F.element_at(F.split(F.col("id").cast("string"), "_"), -1)
    tags = F.when(F.size(_list("tags")) > 0, F.concat(F.lit("> **Tags**: "), F.array_join("tags", ", "), F.lit("\n"))).otherwise("")
    block = F.concat(
        F.lit("## ["), short, F.lit("] "), head, F.lit("\n> **Provenance**: "), F.coalesce("provenance", F.lit("unknown")), F.lit(" | **Date**: "), F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("unknown")),
        F.lit("\n"), tags, F.lit("\n"), "content", F.lit("\n\n---\n\n"),
    )
    rows = bundled.select("dir", "file", "part", "n", "source", F.struct("sequence", "ts", "id", block.alias("b")).alias("r"))
    g = rows.groupBy("dir", "file").agg(F.array_sort(F.collect_list("r")).alias("rs"), F.first("source").alias("source"), F.max("part").alias("part"), F.max("n").alias("n"))
    intro = F.concat(F.lit("# Source: "), F.col("source"), F.lit("\n"), F.when(F.col("n") > BUNDLE, F.concat(F.lit("> Part: "), "part", F.lit("\n"))).otherwise(""), F.lit("\n---\n\n"))
    return g.select("dir", "file", F.concat(intro, F.array_join(F.col("rs.b"), "")).alias("markdown"))


def write_files(docs: DataFrame, root: str) -> DataFrame:
    """Each bundle as the file ``root/dir/file``, by the tasks that hold them; ``root`` is a folder all executors share.

    A file appears whole or not at all, so that a task that runs again only writes the same once more. Gives (dir, file, bytes) when read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                folder = os.path.join(root, r["dir"])
                os.makedirs(folder, exist_ok=True)
                with tempfile.NamedTemporaryFile("w", encoding="utf-8", errors="surrogatepass", newline="", dir=folder, delete=False) as f:
                    f.write(r["markdown"])
                os.replace(f.name, os.path.join(folder, r["file"]))
            sizes = [len(r["markdown"].encode("utf-8", "surrogatepass")) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["dir"] for r in rows]), pa.array([r["file"] for r in rows]), pa.array(sizes, pa.int64())], names=["dir", "file", "bytes"])

    return docs.select("dir", "file", "markdown").mapInArrow(run, "dir string, file string, bytes bigint")
