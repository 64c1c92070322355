"""Near duplicates by 64-bit fingerprints, and exact duplicates by content hash."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_shared


def distance(a, b):  # noqa: ANN001, ANN201
    """Hamming distance of two fingerprints."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) if isinstance(a, str) else F.bit_count(a.bitwiseXOR(b))


def content_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first_key): rows whose content an earlier key has too."""
    h = df.select(key, F.sha2(text, 256).alias("hash")).where("hash is not null")
    first = h.groupBy("hash").agg(F.min(key).alias("first_key"))
    return h.join(first, "hash").where(F.col(key) != F.col("first_key")).select(key, "first_key")


#: Pairs of the four blocks of 16 bits: two values at most two bits apart agree in both blocks of one of them.
BLOCK_PAIRS = tuple((i, j) for i in range(4) for j in range(i + 1, 4))


def _block(c, i: int):  # noqa: ANN001, ANN202
    return F.shiftrightunsigned(c, 16 * i).bitwiseAND(F.lit(0xFFFF))


def band_keys(c: str = "simhash"):  # noqa: ANN201
    """Keys of 32 bits, one per pair of blocks."""
    return F.array(*[F.struct(F.lit(n).alias("band"), (F.shiftleft(_block(F.col(c), j), 16) + _block(F.col(c), i)).alias("bits")) for n, (i, j) in enumerate(BLOCK_PAIRS)])


def near_pairs(df: DataFrame, key: str = "id", c: str = "simhash", most: int = 2) -> DataFrame:
    """(a, b, distance), a < b in value: pairs of *different fingerprints* at most ``most`` (2) bits apart, exact.

    Rows of one fingerprint form a class; pairs are between classes, so that many copies make one entry. Fingerprint 0 (no
    words) takes no part. The values are joined on (band, bits), both sides partitioned alike; keys have 32 bits, so that a cell holds
    few values that aren't near, and a pair counts only in the first band it agrees in."""
    values = df.where(F.col(c) != 0).select(F.col(c).alias("simhash")).distinct()
    banded = values.select("simhash", F.explode(band_keys("simhash")).alias("k")).select("simhash", "k.band", "k.bits")
    left, right = banded.withColumnRenamed("simhash", "a"), banded.withColumnRenamed("simhash", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when((_block(x, i) == 0) & (_block(x, j) == 0), F.lit(n)) for n, (i, j) in enumerate(BLOCK_PAIRS)])
    pairs = left.join(right, ["band", "bits"]).where((F.col("a") < F.col("b")) & (distance("a", "b") <= most) & (F.col("band") == first))
    return pairs.select("a", "b", distance("a", "b").alias("distance"))


def classes(df: DataFrame, key: str = "id", c: str = "simhash") -> DataFrame:
    """(key, simhash, n): membership of every row in the class of its fingerprint."""
    n = df.groupBy(c).agg(F.count("*").alias("n"), F.min(key).alias("first_key"))
    return df.select(key, c).join(n, c).select(key, c, "n", "first_key")


def suppress(results: DataFrame, by: str = "query_id", key: str = "id", c: str = "simhash", order: str = "score") -> DataFrame:
    """Greedy suppression within one query's results: best first, a row within two bits of a kept one is dropped and its tags
    and buckets go to the kept row. Results of a query are few; fingerprint 0 is exempt."""
    schema = results.schema

    def greedy(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r[order], r[key]))
        kept: list[dict] = []
        for r in rows:
            twin = next((k for k in kept if r[c] and k[c] and ((r[c] ^ k[c]) & (2**64 - 1)).bit_count() < 3), None)
            if twin is None:
                kept.append(r)
            else:
                for f in ("tags", "buckets"):
                    twin[f] = list(dict.fromkeys([*(twin[f] or []), *(r[f] or [])]))
        return pa.Table.from_pylist(kept, t.schema)

    return results.groupBy(by).applyInArrow(greedy, schema)


def suppress_all(df: DataFrame, key: str = "id", c: str = "simhash") -> DataFrame:
    """(key): rows kept by the greedy suppression over a whole table, least key first; fingerprint 0 and null are exempt.

    A class stands for its least key. In rounds over the pairs of near classes, those with no undecided earlier neighbour are kept
    and their later neighbours dropped; a round leaves the pairs that are still undecided, so no task holds more than its share."""
    first = df.where(F.col(c) != 0).groupBy(c).agg(F.min(key).alias("first_key"))
    ends = [first.select(F.col(c).alias(x), F.col("first_key").alias(f"{x}_key")) for x in "ab"]
    pairs = near_pairs(df, key, c).join(ends[0], "a").join(ends[1], "b")
    open_pairs = write_shared(pairs.select(F.least("a_key", "b_key").alias("lo"), F.greatest("a_key", "b_key").alias("hi")), "near_pairs")
    dropped = []
    while not open_pairs.isEmpty():
        kept = open_pairs.select("lo").join(open_pairs.select(F.col("hi").alias("lo")), "lo", "left_anti").distinct()
        out = write_shared(open_pairs.join(kept, "lo", "left_semi").select("hi").distinct(), "near_dropped")
        dropped.append(out)
        open_pairs = write_shared(open_pairs.join(out, "hi", "left_anti").join(out.select(F.col("hi").alias("lo")), "lo", "left_anti"), "near_pairs")
    heads = first.select(F.col("first_key").alias(key))
    if dropped:
        heads = heads.join(union_all(dropped).select(F.col("hi").alias(key)), key, "left_anti")
    return heads.unionByName(df.where(F.coalesce(F.col(c), F.lit(0)) == 0).select(key))


def merged_lists(df: DataFrame, by: str, *lists: str) -> DataFrame:
    """Distinct elements of the list columns of each group, in order. Elements are made distinct before they are gathered: what is
    gathered is a group's vocabulary, not its rows."""
    out = df.select(by).distinct()
    for x in lists:
        one = df.select(by, F.explode(x).alias("_x")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("_x")).alias(x))
        out = out.join(one, out[by].eqNullSafe(one[by]), "left").drop(one[by])
    return out.select(by, *[F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in lists])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
