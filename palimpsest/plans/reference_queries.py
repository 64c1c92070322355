"""p1: dangling references of the context tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import references as R
from ..session import norm_key, table

#: (referring table, field, record key, arrival, target)
REFERENCES = (
    ("molecule", "compoundid", "id", "ingested_at", "compound"),
    ("turn_entities", "turn_id", "link_id", "created_at", "conversation_turns"),
    ("turn_entities", "entity_id", "link_id", "created_at", "entities"),
    ("weaver_review", "orig_eid", "review_id", "logged_at", "tmp_audit"),
)
#: (target, key, arrival, column of the deletion time)
TARGETS = (("compound", "id", "ingested_at", None), ("conversation_turns", "id", "created_at", None), ("entities", "id", "first_seen", "deleted_at"), ("tmp_audit", "eid", "loaded_at", None))


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    tombs = table(spark, sf_dir, "deleted_keys").select("target_table", norm_key(F.col("target_key")).alias("key"), R.us(F.col("deleted_at")).alias("deleted_us")).where("key is not null")
    parents = reduce(DataFrame.unionByName, [R.parents_of(table(spark, sf_dir, t), t, k, a, tombs.where(F.col("target_table") == t), d) for t, k, a, d in TARGETS])
    refs = reduce(DataFrame.unionByName, [R.references_of(table(spark, sf_dir, t), t, f, target, k, f, a) for t, f, k, a, target in REFERENCES])
    return R.find_dangling(refs, parents)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dangling(spark, sf_dir).select("ref_table", "ref_field", "ref_key").distinct()


def p1_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_month(dangling(spark, sf_dir))


_NORM = r"nullif(lower(regexp_replace(cast({} as varchar), '^\s+|\s+$', '', 'g')), '')"


def _cases() -> str:
    parts = []
    targets = {t: (k, a, d) for t, k, a, d in TARGETS}
    for t, f, k, a, target in REFERENCES:
        pk, pa_, pd_ = targets[target]
        gone = f"max({pd_})" if pd_ else "cast(null as timestamptz)"
        parts.append(f"""
        select '{t}' as ref_table, '{f}' as ref_field, r.ref_key, r.arrived,
               case when p.key is null then 'absent' when greatest(p.gone, d.gone) >= p.last_at then 'deleted' else 'late' end as reason
        from (select {_NORM.format(f)} as key, cast({k} as varchar) as ref_key, min({a}) as arrived from {t} group by 1, 2) r
        left join (select {_NORM.format(pk)} as key, min({pa_}) as first_at, max({pa_}) as last_at, {gone} as gone from {target} group by 1) p on p.key = r.key
        left join (select {_NORM.format('target_key')} as key, max(deleted_at) as gone from deleted_keys where target_table = '{target}' group by 1) d on d.key = p.key
        where r.key is not null and (p.key is null or greatest(p.gone, d.gone) >= p.last_at or p.first_at > r.arrived)""")
    return " union all ".join(parts)


QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month}
SQL = {
    "p1_found": f"select distinct ref_table, ref_field, ref_key from ({_cases()})",
    "p1_by_month": f"select ref_table, ref_field, strftime(arrived at time zone 'UTC', '%Y-%m') as month, reason, count(*) as dangling from ({_cases()}) group by 1, 2, 3, 4",
}
