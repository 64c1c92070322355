from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import spans as S

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def brute(texts, least):
    seen: dict = {}
    for k, t in texts:
        for i in range(len(t or "") - least + 1):
            seen.setdefault(t[i : i + least], set()).add(k)
    out = {}
    for k, t in texts:
        on = [False] * len(t or "")
        for i in range(len(on) - least + 1):
            if len(seen[t[i : i + least]]) > 1:
                on[i : i + least] = [True] * least
        if any(on):
            out[k] = sum(on)
    return out


def run(spark, texts, least=40, k=16, **kw):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in texts], "doc_id bigint, text string, cid string, s int")
    return {r.doc_id: r.shared_chars for r in S.shared_chars(df.select("doc_id", "text"), "doc_id", "text", least, k, **kw).collect()}


def corpus(seed, n=40):
    rng = random.Random(seed)
    say = lambda m: " ".join(rng.choice(WORDS) + rng.choice(["", "é", "文", "🙂"]) for _ in range(m))
    pool = [say(20) for _ in range(6)]
    texts: list = []
    for i in range(n):
        t = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(pool)
            a, b = sorted(rng.sample(range(len(p)), 2))
            t += " " + p[a:b] + say(rng.randint(0, 8))
        texts.append((i, t))
    texts += [(100, texts[3][1]), (101, texts[3][1]), (102, None), (103, ""), (104, "short"), (105, "ab" * 300), (106, "ab" * 100), (107, pool[0] * 3), (108, pool[0])]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    want = brute(texts, 40)
    assert len(want) > 10
    assert run(spark, texts) == want


def test_hot_nodes_take_the_distributed_way(spark):
    texts = corpus(3)
    assert run(spark, texts, hot=2) == brute(texts, 40)


def shared_node(n):
    """Texts that all hold one stretch; 44 characters around it are common to the i-th of either half only."""
    rng = random.Random(5)
    say = lambda m: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(m))
    pairs = [(say(6), say(6)) for _ in range(n // 2)]
    core = say(32)
    return [(i, say(30) + pairs[i % (n // 2)][0] + core + pairs[i % (n // 2)][1] + say(30)) for i in range(n)]


def test_a_node_of_several_parts_is_one_group(spark):
    texts = shared_node(5000)
    want = brute(texts, 40)
    assert len(want) == 5000
    assert run(spark, texts) == want


def footer(n, pairs):
    """Documents under one footer of 180 characters; pairs of them share 60 more on either side, in places far apart."""
    rng = random.Random(11)
    say = lambda m: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(m))
    foot = say(180)
    sides = [(say(60), say(60)) for _ in range(pairs)]
    texts = [(i, say(80) + foot + say(80)) for i in range(n)]
    for j, (a, b) in enumerate(sides):
        for i in (j, n - 1 - 7 * j):
            texts[i] = (i, say(30) + a + foot + b + say(30))
    want: dict = {}
    for j in range(pairs):
        want |= brute([texts[j], texts[n - 1 - 7 * j]], 200)
    assert len(want) == 2 * pairs and min(want.values()) >= 300
    return texts, want


@pytest.mark.parametrize("hot", [S.HOT, 4000])
def test_a_footer_of_thousands_hides_no_pair(spark, hot):
    texts, want = footer(6000, 100)
    assert run(spark, texts, 200, 72, hot=hot) == want


def test_hashes_only_propose(spark, monkeypatch):
    # all stretches of a node and offset get one key: only the characters can tell them apart
    monkeypatch.setattr(S, "_mix", lambda x: x & np.uint64(0))
    h, cid = np.zeros(8, np.int64), np.array([1, 2, 3, 4, 5, 6, 7, 8])
    core = "c" * 16
    around = [a + core + b for a, b in [("x" * 24, "y" * 24), ("x" * 24, "z" * 24), ("p" * 24, "q" * 24), ("r" * 24, "s" * 24), ("u" * 23 + "x", "y" * 24), ("x" * 24, "y" * 24), ("q" * 24, "r" * 24), ("d" * 24, "e" * 24)]]
    lead = np.full(8, 24)
    got = {int(c): (int(s), int(e)) for c, s, e in zip(*S._compare(h, cid, np.full(8, 100), lead, around, 40))}
    assert got == {1: (76, 140), 2: (76, 116), 5: (99, 140), 6: (76, 140)}


@pytest.mark.parametrize("stretches", [1 << 22, 1000])
def test_parts_of_a_node_wait_for_its_end(monkeypatch, stretches):
    monkeypatch.setattr(S, "STRETCHES", stretches, raising=False)
    texts = [t[16:88] for _, t in shared_node(3000)]
    n = [10, 3000, 20]  # members of a small node, the large one and another small one
    h = np.repeat([-5, 1, 9], n)
    around = ["-" * 72] * 10 + texts + [t + "x" for t in texts[:20]]
    cid = np.arange(len(h))
    batch = pa.RecordBatch.from_arrays([pa.array(h), pa.array(cid), pa.array(cid * 0 + 20), pa.array(cid * 0 + 20), pa.array(around)], names=["h", "cid", "s", "lead", "around"])
    got = [r for b in S._compare_sorted(40)(batch.slice(i, 700) for i in range(0, len(h), 700)) for r in b.to_pylist()]
    assert sorted(r["cid"] for r in got) == list(range(3010))


def test_exact_border(spark):
    body = "".join(chr(0x4E00 + i) for i in range(300))
    texts = [(1, "x" + body[:200] + "y"), (2, "z" + body[:200] + "w"), (3, "q" + body[50:249] + "r")]
    assert run(spark, texts, 200, 72) == brute(texts, 200) == {1: 200, 2: 200}


def test_repeats_within_a_record_and_empty(spark):
    once = "".join(chr(0x5000 + i) for i in range(60))
    assert run(spark, [(1, once * 4)]) == {}
    assert run(spark, []) == {}
    assert run(spark, [(1, None), (2, "")]) == {}


def test_long_texts_in_segments(spark, monkeypatch):
    texts = corpus(4)
    joined = " | ".join(t for _, t in texts if t)
    a = S.choose([joined], 40, 16, 1 << 18)
    b = S.choose([joined], 40, 16, 64)
    assert a[1].tolist() == b[1].tolist() and (a[2] == b[2]).all()


def test_any_shared_stretch_has_a_common_token():
    rng = random.Random(7)
    for _ in range(50):
        core = "".join(rng.choice("abcdefgh") for _ in range(40))
        x, y = ("".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) + core + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) for _ in "ab")
        _, px, hx = S.choose([x], 40, 16)
        _, py, hy = S.choose([y], 40, 16)
        ix, iy = x.index(core), y.index(core)
        inside = lambda ps, hs, i: {(p - i, h) for p, h in zip(ps.tolist(), hs.tolist()) if i <= p <= i + 24}
        assert inside(px, hx, ix) & inside(py, hy, iy)


def test_p8_on_the_tables(spark, sf):
    from palimpsest.llm import queries as q

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.shared_chars for r in q.p8_found(spark, sf).collect()} == brute(texts, 200)
