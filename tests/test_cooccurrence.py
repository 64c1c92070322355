from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

from palimpsest.operators.cooccurrence import PairTable, records

SCHEMA = "id string, atoms array<string>, at timestamp, record string, items string"


def brute(baskets):
    sets = [sorted({x.strip().lower() for x in b or [] if x and x.strip()}) for b in baskets.values()]
    sets = [s for s in sets if s]
    return Counter(p for s in sets for p in combinations(s, 2)), Counter(x for s in sets for x in s), len(sets)


def scores(t):
    return {(r.atom_a, r.atom_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in t.scores().collect()}


def want(baskets):
    p, m, n = brute(baskets)
    return {k: (v, m[k[0]], m[k[1]], n) for k, v in p.items()}


def frame(spark, baskets):
    from datetime import datetime

    return records(spark.createDataFrame([(k, v, datetime(2025, 1, 1), "x", "y") for k, v in baskets.items()], SCHEMA), "s", "id", "atoms", "at")


def test_batches_equal_brute_force(spark):
    rng = random.Random(5)
    draw = lambda: rng.choice([None, [], [rng.choice(["a", " A", "b", "c\n", "D", "d", None, "", "  ", "e"]) for _ in range(rng.randint(1, 6))]])
    now = {f"r{i}": draw() for i in range(60)}
    t = PairTable.fresh(spark, buckets=3)
    t.apply(frame(spark, now))
    assert scores(t) == want(now)
    for _ in range(4):  # runs are merged on the way
        before = want(now)
        change = {f"r{rng.randint(0, 80)}": draw() for _ in range(25)} | {"r1": None, "r2": ["a", "b"]}
        now |= change
        batch = t.apply(frame(spark, change))
        assert scores(t) == want(now)
        after = want(now)
        touched = {(r.atom_a, r.atom_b) for r in t.affected(batch).collect()}
        assert touched >= {k for k, v in after.items() if before.get(k) != v}
        some = {(r.atom_a, r.atom_b): r.n_ab for r in t.scores(t.affected(batch)).collect()}
        assert some == {k: after[k][0] for k in touched}
    assert {level for level, _ in t.runs["pairs"]} == {0, 1}
    again = t.apply(frame(spark, change))  # delivered again
    assert scores(t) == want(now) and t.affected(again).count() == 0
    assert scores(PairTable.reopen(spark, t.root)) == want(now)


def test_affected_without_new_records(spark):
    now = {"1": ["a", "b"], "2": ["a", "c"], "3": ["b", "c"], "4": ["d", "e"]}
    t = PairTable.fresh(spark)
    t.apply(frame(spark, now))
    batch = t.apply(frame(spark, {"2": ["a", "c", "x"], "3": ["b"]}))
    # c lost a record, x is new; (d, e) and (a, b) keep their scores
    assert {(r.atom_a, r.atom_b) for r in t.affected(batch).collect()} == {("a", "c"), ("a", "x"), ("c", "x")}


def test_a_batch_writes_what_it_holds(spark):
    import os

    def size(t, v):
        return sum(os.path.getsize(os.path.join(d, f)) for n in ("baskets", "pairs", "items") for d, _, fs in os.walk(f"{t.root}/{n}") if f"=b{v}/" in d + "/" for f in fs if f.endswith(".parquet"))

    rng = random.Random(1)
    t = PairTable.fresh(spark, buckets=2)
    t.apply(frame(spark, {f"r{i}": [f"w{rng.randint(0, 400)}" for _ in range(12)] for i in range(3000)}))
    t.apply(frame(spark, {"r1": ["x", "y"]}))
    assert size(t, 2) * 10 < size(t, 1)


def test_latest_arrival_counts(spark):
    from datetime import datetime

    rows = [("1", ["a", "b"], datetime(2025, 1, 2), "", ""), ("1", ["a", "c"], datetime(2025, 1, 3), "", ""), ("1", ["a", "b"], None, "", ""), (None, ["q", "r"], None, "", "")]
    t = PairTable.fresh(spark)
    t.apply(records(spark.createDataFrame(rows, SCHEMA), "s", "id", "atoms", "at"))
    assert scores(t) == {("a", "c"): (1, 1, 1, 1)}


def test_empty(spark):
    t = PairTable.fresh(spark)
    t.apply(frame(spark, {}))
    assert scores(t) == {}
    t.apply(frame(spark, {"x": ["a"]}))
    assert scores(t) == {}
