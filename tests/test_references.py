from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from palimpsest.operators import references as R
from palimpsest.session import norm_key

T0 = datetime(2025, 1, 1)
REF = "ref_id string, k string, at timestamp, extra string"
PAR = "k string, at timestamp, gone timestamp, ref_key string"


def run(spark, refs, parents, tombs=None, **kw):
    r = R.references_of(spark.createDataFrame(refs, REF), "t", "k", "p", "ref_id", "k", "at")
    d = spark.createDataFrame(tombs, "key string, deleted_us bigint") if tombs else None
    p = R.parents_of(spark.createDataFrame(parents, PAR), "p", "k", "at", d, "gone")
    return {(x.ref_key, x.reason) for x in R.find_dangling(r, p, **kw).collect()}


def test_reasons_and_spelling(spark):
    day = lambda n: T0 + timedelta(days=n)
    parents = [("A", day(0), None, "x"), ("b ", day(5), None, "x"), ("c", day(0), day(3), "x"), ("d", day(0), day(3), "x"), ("D", day(4), None, "x"), (None, day(0), None, "x")]
    refs = [
        ("1", " a\t", day(1), "e"), ("2", "zz", day(1), "e"), ("3", "B", day(1), "e"), ("4", "b", day(6), "e"), ("5", "c", day(1), "e"), ("6", "d", day(1), "e"),
        ("7", None, day(1), "e"), ("8", "  ", day(1), "e"), ("3", "B", day(9), "e"), ("9", "b", day(5), None), ("10", "b", None, None),
    ]
    assert run(spark, refs, parents) == {("2", "absent"), ("3", "late"), ("5", "deleted")}


def test_tombstones(spark):
    us = lambda n: int((T0 + timedelta(days=n)).timestamp() * 1e6)
    parents = [("a", T0, None, ""), ("b", T0, None, ""), ("b", T0 + timedelta(days=9), None, "")]
    refs = [("1", "a", T0, ""), ("2", "b", T0, "")]
    assert run(spark, refs, parents, [("a", us(3)), ("b", us(3)), ("a", us(1))]) == {("1", "deleted")}


def test_empty_tables(spark):
    assert run(spark, [], [("a", T0, None, "")]) == set()
    assert run(spark, [("1", "a", T0, "")], []) == {("1", "absent")}


@pytest.mark.parametrize("ranges", [(5, 7), (1000, 10**6)])
def test_brute_force_with_a_hot_key_and_many_ranges(spark, ranges):
    rng = random.Random(3)
    keys = [f"k{i:03d}" for i in range(60)]
    parents = [(k, T0 + timedelta(hours=rng.randint(0, 50)), T0 + timedelta(hours=rng.randint(0, 90)) if rng.random() < 0.3 else None, "x") for k in rng.choices(keys, k=50)]
    refs = [(str(i), "k001" if rng.random() < 0.4 else f"k{rng.randint(0, 80):03d}", T0 + timedelta(hours=rng.randint(0, 80)), "x") for i in range(400)]
    got = run(spark, refs, parents, range_keys=ranges[0], slice_refs=ranges[1])
    want = set()
    for rid, k, at, _ in refs:
        own = [p for p in parents if p[0] == k]
        gone = max((p[2] for p in own if p[2]), default=None)
        if not own:
            want.add((rid, "absent"))
        elif gone and gone >= max(p[1] for p in own):
            want.add((rid, "deleted"))
        elif min(p[1] for p in own) > at:
            want.add((rid, "late"))
    assert got == want


def test_norm_key(spark):
    df = spark.createDataFrame([(" Ab ",), ("",), (" ",), (None,), ("7",)], "k string")
    assert [r.x for r in df.select(norm_key(df.k).alias("x")).collect()] == ["ab", None, None, None, "7"]


def test_months(spark):
    refs = R.references_of(spark.createDataFrame([("1", "q", T0, ""), ("2", "q", None, "")], REF), "t", "k", "p", "ref_id", "k", "at")
    parents = R.parents_of(spark.createDataFrame([], PAR), "p", "k", "at", None, "gone")
    got = {(r.month, r.reason, r.dangling) for r in R.by_month(R.find_dangling(refs, parents)).collect()}
    assert got == {("2025-01", "absent", 1), (None, "absent", 1)}


def test_equal_digests_of_different_keys():
    import pyarrow as pa

    parents = pa.table({"target": ["p"] * 4, "key": ["a", "b", "c", "z"], "first_us": [0, 9, 0, 0], "last_us": [0, 9, 0, 0], "gone": [R.EARLY, R.EARLY, 5, R.EARLY], "digest": [7, 7, 7, 8]})
    refs = pa.table({"target": ["p"] * 6, "key": ["a", "b", "c", "d", "y", "z"], "ref_table": ["t"] * 6, "ref_field": ["f"] * 6, "ref_key": list("123456"), "arrived": [3] * 6, "digest": [7, 7, 7, 7, 9, 8]})
    got = R._probe(None, refs, parents)
    assert list(zip(got["ref_key"].to_pylist(), got["reason"].to_pylist())) == [("2", "late"), ("3", "deleted"), ("4", "absent"), ("5", "absent")]
    assert R._probe(None, refs.slice(0, 0), parents).num_rows == 0
    assert set(R._probe(None, refs, parents.slice(0, 0))["reason"].to_pylist()) == {"absent"}
