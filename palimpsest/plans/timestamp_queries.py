"""p4: timestamps of the context tables as instants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timestamps as T
from ..session import table

#: (table, field, record key, column of the local zone)
FIELDS = (("repair_canary_run2", "s_created_at", "repair_id", None), ("repair_canary_run2", "orig_created_at", "repair_id", None), ("conversation_turns", "timestamp", "id", "client_tz"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct non-canonical values; null values and rows in canonical form need no parsing."""
    parts = [
        table(spark, sf_dir, t).select(F.lit(f"{t}.{f}").alias("source"), F.col(k).cast("string").alias("row_key"), F.col(f).alias("value"), (F.col(z) if z else F.lit(None).cast("string")).alias("local_tz"))
        for t, f, k, z in FIELDS
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull() & ~F.col("value").rlike(T.CANONICAL))


def _named(df: DataFrame) -> DataFrame:
    part = lambda i: F.split("source", r"\.")[i]
    return df.withColumns({"src_table": part(0), "src_field": part(1)})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = T.normalise(values(spark, sf_dir), T.US_SLASH_EU_DOT)
    return _named(done.where("status = 'ok'")).select("src_table", "src_field", "row_key", "utc_us").distinct()


def p4_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of formats and outcomes per source when no convention is given: the mixture has to decide the order of day and month."""
    done = T.normalise(values(spark, sf_dir))
    return _named(done).groupBy("src_table", "src_field", "format", "status").agg(F.count("*").alias("n"), F.round(F.min("posterior"), 6).alias("least_posterior"))


def p4_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose best reading stays unsure when no convention is given."""
    left = T.normalise(values(spark, sf_dir)).where("status = 'ambiguous'")
    return _named(left).select("src_table", "src_field", "row_key", "format", "utc_us", F.round("posterior", 6).alias("posterior")).distinct()


QUERIES = {"p4_found": p4_found, "p4_status": p4_status, "p4_ambiguous": p4_ambiguous}

_MONTHS = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DAY = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?"
_NUM = lambda g: f"try_cast({g} as bigint)"
_ABBREVIATIONS = "map {" + ", ".join(f"'{k.lower()}': {v}" for k, v in T.ZONES.items()) + "}"
#: Layout -> (pattern of the date, names of its groups); what follows is the time and the zone.
_LAYOUTS = {
    "iso": (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})[t ](.*)$", "['y', 'm', 'd', 'rest']"),
    "mdy": (r"^(\d{1,2})/(\d{1,2})/(\d{4}),? (.*)$", "['m', 'd', 'y', 'rest']"),
    "dmy": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),? (.*)$", "['d', 'm', 'y', 'rest']"),
    "month_day": (rf"^{_DAY}{_MONTHS}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),? (?:at )?(.*)$", "['m', 'd', 'y', 'rest']"),
    "day_month": (rf"^{_DAY}(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTHS}\.?,?[ -](\d{{4}}),? (?:at )?(.*)$", "['d', 'm', 'y', 'rest']"),
    "basic": (r"^(\d{4})(\d{2})(\d{2})t?(\d{6}.*)$", "['y', 'm', 'd', 'rest']"),
}
_VALUES = " union all ".join(f"select '{t}' as src_table, '{f}' as src_field, cast({k} as varchar) as row_key, {f} as value, {z or 'null'} as tz from {t}" for t, f, k, z in FIELDS)
#: Readings of a layout as SQL of their own: date and time by pattern, zones by name or offset, and the zone's rule asked in both directions.
_CASES = rf"""
with raw as (select distinct * from ({_VALUES}) where value is not null and not regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\.[0-9]{{6}}\+00:00')),
flat as (select *, lower(trim(regexp_replace(value, '[\s\x{{A0}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]+', ' ', 'g'))) as v from raw),
bare as (select *, regexp_replace(v, ' ?(\([^()]*\)|\[[^\[\]]*\])$', '') as b from flat),
parts as ({" union all ".join(f"select src_table, src_field, row_key, tz, '{n}' as layout, regexp_extract(b, '{p}', {g}) as x from bare where regexp_matches(b, '{p}')" for n, (p, g) in _LAYOUTS.items())}),
dated as (select src_table, src_field, row_key, tz, x.y as y, coalesce(nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], x.m), 0), {_NUM("x.m")}) as m, x.d as d,
 case when layout = 'basic' then regexp_replace(x.rest, '^(\d\d)(\d\d)(\d\d)', '\1:\2:\3') else x.rest end as rest from parts),
timed as (select *, regexp_extract(rest, '^(\d{{1,2}}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?: ?([ap])\.?m\.?(?: |$))?(?: ?([a-z+-].*))?$', ['h', 'mi', 's', 'f', 'ap', 'z']) as t from dated where regexp_matches(rest, '^(\d{{1,2}}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?: ?([ap])\.?m\.?(?: |$))?(?: ?([a-z+-].*))?$')),
walls as (select src_table, src_field, row_key, coalesce(nullif(trim(tz), ''), 'UTC') as tz, t.z as z, try_cast(y || '-' || m || '-' || d as date) as day, coalesce({_NUM("nullif(t.s, '')")}, 0) as s, {_NUM("t.mi")} as mi,
 case when t.ap = '' then {_NUM("t.h")} when {_NUM("t.h")} between 1 and 12 then {_NUM("t.h")} % 12 + case when t.ap = 'p' then 12 else 0 end end as h, {_NUM("substr(t.f || '000000', 1, 6)")} as f from timed),
good as (select *, (day + to_hours(h) + to_minutes(mi) + to_seconds(s)) + to_microseconds(f) as wall from walls where day is not null and h between 0 and 23 and mi < 60 and s < 60),
zoned as (select *, regexp_extract(z, '^(?:utc|gmt)? ?([+-])(\d\d):?(\d\d)?$', ['sign', 'hh', 'mm']) as o from good),
shifted as (select *, case when o.hh <> '' and {_NUM("o.hh")} <= 15 then (case when o.sign = '-' then -1 else 1 end) * (60 * {_NUM("o.hh")} + coalesce({_NUM("nullif(o.mm, '')")}, 0)) else {_ABBREVIATIONS}[z] end as minutes,
 case when z = '' then tz when contains(z, '/') then (select any_value(name) from pg_timezone_names() where lower(name) = z) end as rule from zoned),
ruled as (select *, case when rule is not null then timezone(rule, wall) end as u from shifted),
told as (select src_table, src_field, row_key, case when minutes is not null then epoch_us(wall) - minutes * 60000000
 when u is not null and timezone(rule, u) = wall and len(list_filter(range(-8, 9), lambda i: i <> 0 and timezone(rule, u + to_minutes(15 * i)) = wall)) = 0 then epoch_us(u) end as utc_us from ruled),
numbers as (select src_table, src_field, row_key, unnest([0, 3, 6, 9]) as digits, try_cast(string_split(v, '.')[1] as hugeint) as whole, substr(coalesce(string_split(v, '.')[2], '') || '000000', 1, 6) as f from flat where regexp_full_match(v, '\d{{9,19}}(\.\d+)?')),
epochs as (select src_table, src_field, row_key, case digits when 0 then whole * 1000000 + cast(f as bigint) when 3 then whole * 1000 + cast(substr(f, 1, 3) as bigint) when 6 then whole else whole // 1000 end as utc_us from numbers)
select distinct src_table, src_field, row_key, cast(utc_us as bigint) as utc_us from (select * from told where utc_us is not null union all select * from epochs where utc_us >= {T.PLAUSIBLE[0]} and utc_us < {T.PLAUSIBLE[1]})
"""
SQL = {"p4_found": _CASES}
