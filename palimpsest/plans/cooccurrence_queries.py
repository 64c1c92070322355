"""p5: atoms that appear together in molecules and in compounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cooccurrence import Batch, PairTable, records
from ..session import table


#: Ends of the batches, as shares of the time from the first arrival to the last (a record that comes again belongs to several).
BATCHES = (0.6, 0.85, 1.0)
SPACES = ("molecule", "compound")


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Changed records of each batch, by arrival."""
    cuts = {}
    for t in SPACES:
        lo, hi = table(spark, sf_dir, t).agg(F.min(F.unix_micros("ingested_at")), F.max(F.unix_micros("ingested_at"))).first()
        cuts[t] = [None if lo is None else lo + int((hi - lo) * 100) * round(100 * b) // 10_000 for b in BATCHES]
    out = []
    for i in range(len(BATCHES)):
        parts = []
        for t in SPACES:
            at, ends = F.unix_micros("ingested_at"), cuts[t]
            after = (at > ends[i - 1]) if i and ends[i] is not None else F.lit(not i)
            until = (at <= ends[i]) if ends[i] is not None else F.lit(True)
            mine = (until | at.isNull()) if not i else after & until
            parts.append(records(table(spark, sf_dir, t).where(mine), t, "id", "atoms", "ingested_at"))
        out.append(parts[0].unionByName(parts[1]))
    return out


def _applied(spark: SparkSession, sf_dir: str) -> tuple[PairTable, Batch]:
    """The table after all batches, and what the last one moved."""
    state = PairTable.fresh(spark)
    for changed in _batches(spark, sf_dir):
        last = state.apply(changed)
    return state, last


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.col(c).cast("decimal(38,0)")
    case = (F.col("n_ab") >= 5) & (1000 * F.col("n_ab") >= F.col("n")) & (n("n_ab") * n("n") >= n("n_a") * n("n_b") * 5)
    return _applied(spark, sf_dir)[0].scores().where(case).select(F.col("space").alias("src_table"), "atom_a", "atom_b")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("space").alias("src_table"), "atom_a", "atom_b", "n_ab", "n_a", "n_b", F.col("n").alias("n_records"), F.round("lift", 6).alias("lift"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its counts and its association."""
    return _shown(_applied(spark, sf_dir)[0].scores())


def p5_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose association the last batch moved, with their counts and association after it."""
    state, last = _applied(spark, sf_dir)
    return _shown(state.scores(state.affected(last)))


_COUNTS = r"""
with raw as (select 'molecule' as src_table, id, atoms from molecule union all select 'compound', id, atoms from compound),
item as (select distinct src_table, id, a from (select src_table, id, lower(regexp_replace(unnest(atoms), '^\s+|\s+$', '', 'g')) as a from raw) where a <> ''),
n as (select src_table, count(distinct id) as n_records from item group by 1),
m as (select src_table, a, count(*) as n from item group by 1, 2),
p as (select x.src_table, x.a as atom_a, y.a as atom_b, count(*) as n_ab from item x join item y on x.src_table = y.src_table and x.id = y.id and x.a < y.a group by 1, 2, 3),
s as (select p.*, ma.n as n_a, mb.n as n_b, n_records from p join m ma on ma.src_table = p.src_table and ma.a = atom_a join m mb on mb.src_table = p.src_table and mb.a = atom_b join n on n.src_table = p.src_table)
"""
def _counts(until: float) -> str:
    """The counts of the arrivals up to a share of the time, the latest arrival of each record alone."""
    rows = " union all ".join(
        f"select '{t}' as src_table, id, ingested_at as came, atoms, epoch_us(ingested_at) <= (select min(epoch_us(ingested_at)) + (max(epoch_us(ingested_at)) - min(epoch_us(ingested_at))) * 100 * {round(100 * until)} // 10000 from {t}) or ingested_at is null as here from {t} where id is not null"
        for t in SPACES
    )
    return rf"""
raw as ({rows}),
latest as (select src_table, id, arg_max(atoms, coalesce(came, timestamptz '0001-01-01')) as atoms from raw where here group by 1, 2),
item as (select distinct src_table, id, a from (select src_table, id, lower(regexp_replace(unnest(atoms), '^\s+|\s+$', '', 'g')) as a from latest) where a <> ''),
n as (select src_table, count(distinct id) as n_records from item group by 1),
m as (select src_table, a, count(*) as n from item group by 1, 2),
p as (select x.src_table, x.a as atom_a, y.a as atom_b, count(*) as n_ab from item x join item y on x.src_table = y.src_table and x.id = y.id and x.a < y.a group by 1, 2, 3),
s as (select p.*, ma.n as n_a, mb.n as n_b, n_records from p join m ma on ma.src_table = p.src_table and ma.a = atom_a join m mb on mb.src_table = p.src_table and mb.a = atom_b join n on n.src_table = p.src_table)
"""


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs, "p5_affected": p5_affected}
_LIFT = "round(n_ab / (cast(n_a as double) * n_b / n_records), 6) as lift"
SQL = {
    "p5_found": _COUNTS + "select src_table, atom_a, atom_b from s where n_ab >= 5 and 1000 * n_ab >= n_records and n_ab * n_records >= 5 * n_a * n_b",
    "p5_pairs": _COUNTS + f"select src_table, atom_a, atom_b, n_ab, n_a, n_b, n_records, {_LIFT} from s",
    "p5_affected": f"""with before as (with {_counts(BATCHES[-2])} select * from s), after as (with {_counts(1.0)} select * from s)
 select a.src_table, a.atom_a, a.atom_b, a.n_ab, a.n_a, a.n_b, a.n_records, round(a.n_ab / (cast(a.n_a as double) * a.n_b / a.n_records), 6) as lift from after a left join before b using (src_table, atom_a, atom_b)
 where (a.n_ab, a.n_a, a.n_b, a.n_records) is distinct from (b.n_ab, b.n_a, b.n_b, b.n_records)""",
}
