"""Session helpers: tables of a directory, the shared folder, and the ANSI-safe text normalisers every operator uses."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space and invisible characters, as a Java regex class body.
BLANKS = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}\x{AD}"


def build_session(app: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE), whose workers find this package; explicit ``conf`` entries win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    on_workers(spark)
    return spark


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies on a path they see too and isn't installed (else ship it with --py-files)."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than that (one small file); a larger input stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < min(n, 64) else df


#: Folders that this process wrote, and their sessions.
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``); ``release`` removes it.

    Only a local session may leave that setting out (tests): it gets a temporary folder. On a cluster its absence is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            root = set_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="palimpsest_")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{what}_{uuid.uuid4().hex[:12]}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    return path


def release() -> None:
    """Remove the shared folders written so far. Results that were not yet read from them are lost; at the end of the process it runs by itself."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session has ended: nothing can be removed through it
            continue


def write_shared(df: DataFrame, what: str, *partition: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(c, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")


def norm_key(c: Column) -> Column:
    """Key as it compares: text, without surrounding white space, lower case; blank becomes null."""
    k = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)
