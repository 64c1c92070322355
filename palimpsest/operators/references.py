"""References to records that do not exist.

Keys are range-partitioned in the order of their 64-bit digest: ranges of equal width hold about as many keys each, so their
number follows from the number of parents alone, without a sample and without a bound on it. Each range's parents are one
sorted array of digests beside their keys and times; references are probed against it in vectorised batches by binary
search, and the keys themselves are compared at the places found, so that equal digests of different keys change nothing.
A range that many references hit (one hot key may take a third of all rows) is split into salted slices; its array, which
is bounded by the range size, is copied to every slice. Both sides are normalised and written once; every later pass reads
what was written. The number of tasks grows with the ranges and slices.

Defined results: a null or blank reference is no reference; a repeated record counts once, with its first arrival; an
absent arrival time of a parent counts as "always there", one of a record as "after everything"; of several deletions the
last counts; an empty parent table leaves every reference dangling; an empty reference table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import norm_key, write_shared

EARLY, LATE = -(2**62), 2**62
#: Keys a range aims at, and references a slice aims at.
RANGE_KEYS, SLICE_REFS = 50_000, 100_000

FINDING = "ref_table string, ref_field string, ref_key string, arrived bigint, reason string"


def us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def parents_of(df: DataFrame, target: str, key: str, arrival: str, deleted: DataFrame | None = None, deleted_col: str | None = None) -> DataFrame:
    """(target, key, first_us, last_us, deleted_us), one row per key. ``deleted``: (key, deleted_us) of tombstones."""
    p = df.select(norm_key(F.col(key)).alias("key"), us(F.col(arrival)).alias("at"), (us(F.col(deleted_col)) if deleted_col else F.lit(None).cast("bigint")).alias("gone"))
    p = p.where("key is not null").groupBy("key").agg(
        F.min(F.coalesce("at", F.lit(EARLY))).alias("first_us"), F.max(F.coalesce("at", F.lit(EARLY))).alias("last_us"), F.max("gone").alias("deleted_us")
    )
    if deleted is not None:
        d = deleted.groupBy("key").agg(F.max("deleted_us").alias("tomb_us"))
        p = p.join(d, "key", "left").select("key", "first_us", "last_us", F.greatest("deleted_us", "tomb_us").alias("deleted_us"))
    return p.select(F.lit(target).alias("target"), "key", "first_us", "last_us", "deleted_us")


def references_of(df: DataFrame, ref_table: str, ref_field: str, target: str, record: str, ref: str, arrival: str) -> DataFrame:
    """(target, key, ref_table, ref_field, ref_key, arrived): one row per record and distinct reference, with its first arrival."""
    r = df.select(norm_key(F.col(ref)).alias("key"), F.col(record).cast("string").alias("ref_key"), us(F.col(arrival)).alias("at"))
    r = r.where("key is not null").groupBy("key", "ref_key").agg(F.min(F.coalesce("at", F.lit(LATE))).alias("arrived"))
    return r.select(F.lit(target).alias("target"), "key", F.lit(ref_table).alias("ref_table"), F.lit(ref_field).alias("ref_field"), "ref_key", "arrived")


def digest() -> Column:
    """Digest by whose order keys are range-partitioned."""
    return F.xxhash64("target", "key")


def _probe(_key, refs: pa.Table, parents: pa.Table) -> pa.Table:
    """Binary search of one slice of references in the sorted array of its range."""
    parents = parents.take(pc.sort_indices(parents["digest"]))
    keys, first, last, gone = (parents[c].to_numpy() for c in ("digest", "first_us", "last_us", "gone"))
    want, arrived = refs["digest"].to_numpy(), refs["arrived"].to_numpy()
    names, wanted = (pc.binary_join_element_wise(t["target"], t["key"], "\x01").combine_chunks() for t in (parents, refs))
    at, hit = np.searchsorted(keys, want), np.zeros(len(want), bool)
    look = np.flatnonzero(at < len(keys))
    while len(look):  # once, but for different keys of one digest: those go on to the next place
        look = look[keys[at[look]] == want[look]]
        same = pc.equal(names.take(pa.array(at[look])), wanted.take(pa.array(look))).to_numpy(zero_copy_only=False)
        hit[look[same]] = True
        look = look[~same]
        at[look] += 1
        look = look[at[look] < len(keys)]
    reason = np.full(len(want), "absent", dtype=object)
    found = np.flatnonzero(hit)
    p = at[found]
    reason[found] = np.where((gone[p] > EARLY) & (last[p] <= gone[p]), "deleted", np.where(first[p] > arrived[found], "late", ""))
    miss = np.flatnonzero(reason != "")
    out = refs.select(["ref_table", "ref_field", "ref_key", "arrived"]).take(pa.array(miss))
    return out.append_column("reason", pa.array(reason[miss], pa.string()))


def find_dangling(refs: DataFrame, parents: DataFrame, range_keys: int = RANGE_KEYS, slice_refs: int = SLICE_REFS) -> DataFrame:
    """Dangling references: FINDING rows, each with its reason (absent, deleted, late)."""
    spark = refs.sparkSession
    parents = write_shared(parents.select("target", "key", "first_us", "last_us", F.coalesce("deleted_us", F.lit(EARLY)).alias("gone"), digest().alias("digest")), "parents")
    refs = write_shared(refs.withColumn("digest", digest()), "references")
    n_keys, n_refs = parents.count(), refs.count()  # from the files' footers
    bits = max(0, math.ceil(math.log2(max(1, n_keys / range_keys))))
    ranged = lambda df: df.withColumn("range", F.shiftrightunsigned("digest", 64 - bits) if bits else F.lit(0).cast("bigint"))
    # only ranges that need several slices: at most n_refs / slice_refs of them
    wide = ranged(refs.select("digest")).groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > slice_refs).select("range", F.ceil(F.col("n") / slice_refs).alias("width"))
    wide = F.broadcast(wide)
    width = F.coalesce("width", F.lit(1).cast("bigint"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2**bits + n_refs // slice_refs)
    salt = F.pmod(F.xxhash64("ref_table", "ref_field", "ref_key"), width)  # of the record, so that a hot key is spread over its range's slices
    sliced = ranged(refs).join(wide, "range", "left").withColumn("slice", salt).drop("width").repartition(tasks, "range", "slice")
    copies = ranged(parents).join(wide, "range", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), width - 1))).drop("width").repartition(tasks, "range", "slice")
    return sliced.groupBy("range", "slice").cogroup(copies.groupBy("range", "slice")).applyInArrow(_probe, FINDING)


def by_month(found: DataFrame) -> DataFrame:
    """Counts of dangling references per table, field, reason and month of the record's first arrival (null: unknown)."""
    month = F.when(F.col("arrived") < LATE, F.date_format(F.timestamp_micros("arrived"), "yyyy-MM"))
    return found.groupBy("ref_table", "ref_field", month.alias("month"), "reason").agg(F.count("*").alias("dangling"))
