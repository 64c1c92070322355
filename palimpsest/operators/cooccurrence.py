"""Items that appear together: an incremental pair table with association scores.

State lives in a folder as Parquet runs, hash-bucketed by key and never changed once written. ``baskets`` holds the items of
each record as of a batch; ``pairs``, ``items`` and ``total`` hold signed counts. A batch of changed records is compared with
their last baskets and emits signed deltas: -1 for every pair and item of the old basket, +1 for those of the new one.
Deltas are summed (map side first) and added as one run of the buckets they touch; counts are the sums over the runs. Runs
of like size are merged (``FAN`` of one level give one of the next), so that every delta is rewritten a logarithmic number
of times: what a batch writes follows from the batch, not from the state. A first batch is the same step from an empty
state. The list of runs is written with every batch (``reopen``).

An association score depends on a pair's count, its items' counts and the number of records. The pairs a batch affects are
therefore those whose count moved, those of an item whose count moved, and, if the number of records moved, all of that
space; ``affected`` gives them, and ``scores`` computes their current scores from the counts.

Defined results: items compare trimmed and in lower case; null, blank and repeated items do not count; a record with no
item left has no basket; of several rows of one record the latest arrival counts (ties: the greatest list); deleting a
record is a batch row with null items; a batch that is delivered again changes nothing. Wide baskets are exploded pair by
pair in the scan, never collected.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import norm_key, shared_dir

#: Runs of one level that are merged into one of the next.
FAN = 4
#: Keys and columns of each table.
TABLES = {
    "baskets": (["space", "record"], "space string, record string, items array<string>, was array<string>, batch int, bucket int"),
    "pairs": (["space", "atom_a", "atom_b"], "space string, atom_a string, atom_b string, n bigint, bucket int"),
    "items": (["space", "atom"], "space string, atom string, n bigint, bucket int"),
    "total": (["space"], "space string, n bigint, bucket int"),
}


def basket(items: Column) -> Column:
    """Distinct normalised items in order."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(items, F.array().cast("array<string>")), norm_key))))


def records(df: DataFrame, space: str, record: str, items: str, arrival: str) -> DataFrame:
    """(space, record, items): one basket per record, the latest arrival's."""
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record"), F.struct(F.col(arrival).alias("at"), basket(F.col(items)).alias("items")).alias("v"))
    return rows.groupBy("record").agg(F.max("v").alias("v")).select(F.lit(space).alias("space"), "record", F.col("v.items").alias("items"))


def _pairs(df: DataFrame, items: str, sign: str) -> DataFrame:
    """(space, atom_a, atom_b, d) of every pair of a sorted basket; the inner list shrinks as the position grows."""
    first = df.select("space", F.col(sign).alias("d"), F.col(items).alias("x"), F.posexplode(items).alias("p", "atom_a"))
    return first.select("space", "atom_a", F.explode(F.slice("x", F.col("p") + 2, F.size("x"))).alias("atom_b"), "d")


def _none() -> Column:
    return F.array().cast("array<string>")


@dataclass
class Batch:
    """What a batch moved: signed counts of pairs and items, and of the records of each space."""

    pairs: DataFrame
    items: DataFrame
    total: DataFrame


@dataclass
class PairTable:
    """Pair counts below ``root``, in ``buckets`` by hash. ``runs``: by table, the (level, path) of every run, oldest first."""

    spark: SparkSession
    root: str
    buckets: int = 16
    version: int = 0
    runs: dict[str, list[tuple[int, str]]] = field(default_factory=lambda: {t: [] for t in TABLES})

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int | None = None) -> PairTable:
        """An empty table; as many buckets as the session's shuffles have partitions, unless told otherwise."""
        return cls(spark, shared_dir(spark, "pair_table"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    @classmethod
    def reopen(cls, spark: SparkSession, root: str) -> PairTable:
        """The table as its last complete batch left it."""
        state = json.loads(max(spark.read.text(f"{root}/manifest").collect(), key=lambda r: json.loads(r.value)["version"]).value)
        return cls(spark, root, state["buckets"], state["version"], {t: [tuple(r) for r in rs] for t, rs in state["runs"].items()})

    def _runs(self, name: str, paths: list[str]) -> DataFrame:
        schema = TABLES[name][1]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*[f.split()[0] for f in schema.split(", ")]) if paths else self.spark.createDataFrame([], schema)

    def _sum(self, name: str, df: DataFrame) -> DataFrame:
        keys, _ = TABLES[name]
        if name == "baskets":
            return df.groupBy(*keys).agg(F.max(F.struct("batch", "items")).alias("v")).select(*keys, "v.items", F.lit(None).cast("array<string>").alias("was"), "v.batch")
        return df.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def _write(self, name: str, df: DataFrame, path: str) -> None:
        bucket = F.pmod(F.xxhash64(*TABLES[name][0]), F.lit(self.buckets)).cast("int")
        df.withColumn("bucket", bucket).repartition(self.buckets, "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)

    def _add(self, name: str, df: DataFrame) -> DataFrame:
        """Write a batch's rows as a run, and merge runs of like level."""
        path = f"{self.root}/{name}/run=b{self.version}"
        self._write(name, df, path)
        runs = self.runs[name]
        runs.append((0, path))
        while len(runs) >= FAN and len({level for level, _ in runs[-FAN:]}) == 1:
            level = runs[-1][0] + 1
            merged = f"{self.root}/{name}/run=m{self.version}_{level}"
            self._write(name, self._sum(name, self._runs(name, [p for _, p in runs[-FAN:]])), merged)
            runs[-FAN:] = [(level, merged)]
        return self._runs(name, [path])

    def read(self, name: str) -> DataFrame:
        """Current rows of a table: counts that aren't zero; the last basket of each record, an empty one where it was deleted."""
        return self._sum(name, self._runs(name, [p for _, p in self.runs[name]]))

    def apply(self, changed: DataFrame) -> Batch:
        """Add a batch (space, record, items; at most one row of a record); null or empty items delete the record."""
        self.version += 1
        new = changed.select("space", "record", F.coalesce("items", _none()).alias("items"))
        if self.runs["baskets"]:
            # only the baskets of the batch's records move
            old = self._runs("baskets", [p for _, p in self.runs["baskets"]]).join(new.select("space", "record"), ["space", "record"], "left_semi")
            both = new.withColumn("batch", F.lit(self.version)).unionByName(old.select("space", "record", "items", "batch"))
            mine = F.col("batch") == self.version
            both = both.groupBy("space", "record").agg(F.max_by("items", F.when(mine, 1)).alias("items"), F.coalesce(F.max_by("items", F.when(~mine, F.col("batch"))), _none()).alias("was"))
            moved = both.where(~F.col("items").eqNullSafe(F.col("was")))
        else:
            moved = new.where(F.size("items") > 0).withColumn("was", _none())
        moved = self._add("baskets", moved.select("space", "record", "items", "was", F.lit(self.version).alias("batch")))
        signed = moved.select("space", F.explode(F.array(F.struct(F.lit(-1).alias("d"), F.col("was").alias("items")), F.struct(F.lit(1).alias("d"), "items"))).alias("e"))
        signed = signed.select("space", "e.d", "e.items").where(F.size("items") > 0)
        pairs = _pairs(signed.where(F.size("items") > 1), "items", "d").groupBy("space", "atom_a", "atom_b").agg(F.sum("d").alias("n")).where("n <> 0")
        items = signed.select("space", "d", F.explode("items").alias("atom")).groupBy("space", "atom").agg(F.sum("d").alias("n")).where("n <> 0")
        total = signed.groupBy("space").agg(F.sum("d").alias("n")).where("n <> 0")
        with ThreadPoolExecutor(3) as pool:  # three jobs that don't wait for each other
            batch = Batch(*pool.map(self._add, ("pairs", "items", "total"), (pairs, items, total)))
        state = json.dumps({"version": self.version, "buckets": self.buckets, "runs": self.runs})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/v={self.version}")
        return batch

    def affected(self, batch: Batch) -> DataFrame:
        """(space, atom_a, atom_b): every pair of the table whose score the batch moved; pairs that are gone are not among them."""
        p = self.read("pairs")
        whole = batch.total.select("space", F.lit(True).alias("whole"))
        hot = batch.items.select("space", "atom")
        side = lambda x: hot.select("space", F.col("atom").alias(f"atom_{x}"), F.lit(True).alias(f"m_{x}"))
        own = batch.pairs.select("space", "atom_a", "atom_b", F.lit(True).alias("m_own"))
        p = p.join(whole, "space", "left").join(side("a"), ["space", "atom_a"], "left").join(side("b"), ["space", "atom_b"], "left").join(own, ["space", "atom_a", "atom_b"], "left")
        return p.where(F.coalesce("whole", "m_a", "m_b", "m_own", F.lit(False))).select("space", "atom_a", "atom_b")

    def scores(self, only: DataFrame | None = None) -> DataFrame:
        """(space, atom_a, atom_b, n_ab, n_a, n_b, n, lift, pmi) of all pairs, or of those in ``only`` (``affected``)."""
        p = self.read("pairs").withColumnRenamed("n", "n_ab")
        if only is not None:
            p = p.join(only, ["space", "atom_a", "atom_b"], "left_semi")
        m = self.read("items")
        side = lambda x: m.select("space", F.col("atom").alias(f"atom_{x}"), F.col("n").alias(f"n_{x}"))
        p = p.join(side("a"), ["space", "atom_a"]).join(side("b"), ["space", "atom_b"]).join(self.read("total"), "space")
        chance = F.col("n_a").cast("double") * F.col("n_b") / F.col("n")
        lift = F.col("n_ab") / chance
        return p.select("space", "atom_a", "atom_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
