from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import windows as W


def check(sizes, capacity):
    x = np.array(sorted(sizes, reverse=True), np.int64)
    slots = W.fill(x, capacity)
    used = np.bincount(slots, weights=x) if len(x) else np.zeros(0)
    assert len(slots) == len(x) and (not len(x) or (used.max() <= capacity and used.min() > 0))
    return len(used), W.least_windows(x, capacity) if len(x) else 0


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_capacity_holds(sizes):
    check(sizes, 100)


@pytest.mark.parametrize("sizes", [[60] * 9, [100] * 5, [1] * 500, [99, 1] * 30, [50] * 7, [34] * 12, [7]])
def test_known(sizes):
    made, _ = check(sizes, 100)
    per = max(1, 100 // max(sizes)) if len(set(sizes)) == 1 else None
    assert made == (-(-len(sizes) // per) if per else 30)


def test_near_the_lower_bound():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(5.4, 0.8, 3000), 5, 2048).astype(int)
    made, least = check(sizes.tolist(), 2048)
    assert made <= least + 3


def test_partition_is_even():
    sizes = np.array([8, 7, 6, 5, 4])
    sums = np.bincount(W.partition(sizes, 2), weights=sizes)
    assert sorted(sums) in ([14, 16], [15, 15])


def rows(spark, items, n=None, capacity=10, group=4):
    df = spark.createDataFrame(items, "item_key bigint, n_tokens bigint, window_id string, piece string")
    return W.pack(df, n or len(items), capacity, group).collect()


def test_pack(spark):
    items = [(1, 25, "", ""), (2, 10, "", ""), (3, 3, "", ""), (4, 7, "", ""), (5, None, "", ""), (6, 0, "", ""), (7, 4, "", ""), (7, 4, "", ""), (8, 20, "", "")]
    got = rows(spark, items)
    by_item: dict = {}
    used: dict = {}
    for r in got:
        by_item.setdefault(r.item_key, []).append(r.n_tokens)
        used.setdefault(r.window_id, []).append((r.offset, r.n_tokens))
    assert {k: sum(v) for k, v in by_item.items()} == {1: 25, 2: 10, 3: 3, 4: 7, 7: 8, 8: 20}
    assert sorted(by_item[1]) == [5, 10, 10] and by_item[8] == [10, 10]
    assert sorted({r.piece for r in got if r.item_key == 1}) == [0, 1, 2]
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 10


def test_empty(spark):
    assert rows(spark, [], 0) == []


def test_p7_on_the_tables(spark, sf):
    from palimpsest.llm import queries as q

    w = q.p7_windows(spark, sf).toPandas()
    assert w.groupby("window_id").n_tokens.sum().max() <= 2048
    n = {r.doc_id: len(r.ids) for r in q.p6_ids(spark, sf).collect()}
    got = w.groupby("doc_id").n_tokens.sum().to_dict()
    assert got == {k: v for k, v in n.items() if v}
    whole = w.groupby("doc_id").window_id.nunique()
    assert all(whole[k] == 1 for k, v in n.items() if 0 < v <= 2048)
