from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import kernels as K
from palimpsest.operators import dedup, graph, links, mirror, packing
from palimpsest.operators import organize as O
from palimpsest.operators import retrieval as R
from palimpsest.operators import stats as S
from palimpsest.sources import files
from palimpsest.streaming import ingest

T0 = datetime(2025, 1, 1)
MEM = "id bigint, content string, source string, ts timestamp, buckets array<string>, tags array<string>, provenance string, type string, sequence int"


def mem(spark, rows):
    return spark.createDataFrame([(i, c, s, T0 + timedelta(hours=i), b, t, p, k, i) for i, c, s, b, t, p, k in rows], MEM)


ROWS = [
    (1, "red pump pump", "a.md", ["x"], ["t1"], "internal", "prose"),
    (2, "red pump", "b.md", ["y"], ["t1", "t2"], "external", "code"),
    (3, "blue valve", "c.md", ["x"], ["t2"], "external", "prose"),
    (4, "red pump", "d.md", ["x"], ["t1"], "quarantine", "prose"),
    (5, "green", None, None, None, None, "prose"),
]


def test_anchor_walk_and_scores(spark):
    m = mem(spark, ROWS)
    f = R.term_frame(spark, {(1, 1): ["red", "pump"], (2, 1): ["zebra"]})
    a = R.anchors(m, f, 5, R.trusted("default"))
    assert [r.id for r in a.orderBy("rank").collect()] == [1, 2]
    w = R.tag_walk(m, a, 5, R.trusted("default"))
    assert [(r.query_id, r.id, r.score) for r in w.collect()] == [(1, 3, 30.0)]
    boosted = {r.id: r.score / a_.score for r, a_ in zip(R.boosted(a).orderBy("id").collect(), a.orderBy("id").collect())}
    assert boosted == pytest.approx({1: 2.0, 2: 0.8})
    assert {r.id for r in R.anchors(m, f, 5, R.trusted("quarantine")).collect()} == {4}


def test_search_backs_off_and_unites(spark):
    m = mem(spark, ROWS)
    got = R.search(m, [R.Request(1, "", attempts=[["zebra"], ["valve"]])], 4000)
    assert {(r.id, r.attempt) for r in got.collect()} == {(3, 2), (2, None)}
    both = R.smart_search(m, [R.Request(1, "pump valve")], 4000)
    assert {r.id for r in both.collect()} == {1, 2, 3}
    assert R.search(m, [R.Request(1, "zebra")], 4000).collect() == []


def test_more_terms_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_TERMS", 3)
    m = spark.createDataFrame([(i, f"word{i} common text") for i in range(20)], "id bigint, content string")
    f = R.term_frame(spark, {(i, 1): [f"word{i}", "common"] for i in range(6)})
    assert sorted((r.query_id, r.id) for r in R.fts(m, f).collect()) == [(i, i) for i in range(6)]


def test_parts_do_not_clash_with_ids(spark):
    rows = [(i, f"alpha{i % 3} beta", "s", ["b"], ["t"], "internal", "prose", None) for i in range(9)]
    m = spark.createDataFrame(rows, "id bigint, content string, source string, buckets array<string>, tags array<string>, provenance string, type string, ts timestamp")
    got = R.smart_search(m, [R.Request(1, "alpha0"), R.Request(1000, "alpha1"), R.Request(2001, "alpha2")], 4000).collect()
    assert {r.query_id for r in got} == {1, 1000, 2001}


def test_scopes_and_exact_keys(spark):
    rows = [(1, "valve report", "s", ["notebook"], ["x"], "internal", "prose", None), (2, "valve list", "s", ["journal"], ["x"], "internal", "prose", None), (3, "no match", "s", ["notebook"], ["y"], "internal", "prose", None)]
    m = spark.createDataFrame(rows, "id bigint, content string, source string, buckets array<string>, tags array<string>, provenance string, type string, ts timestamp")
    e = spark.createDataFrame([("valve", "[3]")], "text string, value string").select(R.engram_key(F.col("text")).alias("key"), "value")
    got = {(r.query_id, r.id): (r.score, r.turn) for r in R.execute(m, [R.Request(1, "valve #notebook"), R.Request(2, "valve")], 4000, engrams=e).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)}
    assert got[1, 3] == got[2, 3] == (200.0, 1e18) and got[2, 1][0] > 0


def test_packing(spark):
    rows = [(i, "word. " * 50, "s", ["b"], [], "internal", "prose") for i in range(1, 6)]
    m = mem(spark, rows).withColumns({"query_id": F.lit(1), "score": 10.0 - F.col("id")})
    p = packing.pack(packing.mixed_score(m, "q", "2025-01-02 00:00:00"), 300).orderBy("position").collect()
    budget = int(300 * 0.95) * 4
    assert [r.id for r in p] == [1, 2, 3, 4] and p[3].packed.endswith(" [Truncated]")
    assert sum(len(r.packed) for r in p) <= budget + len(" [Truncated]")
    assert packing.prompt(packing.pack(packing.mixed_score(m, "q", "2025-01-02 00:00:00"), 300)).first().prompt.startswith("[Source: s] (2025-01-01T01:00:00.000Z)\nword.")


def test_elastic_windows(spark):
    d = spark.createDataFrame([(1, "x" * 1000 + "Needle" + "y" * 20 + "needle" + "z" * 3000 + "NEEDLE"), (2, "none"), (3, None)], "id bigint, content string")
    got = [(r.start, r.end) for r in packing.elastic_windows(d, ["needle"], 900).orderBy("start").collect()]
    assert got == [(850, 1182), (3882, 4038)]
    assert all("eedle" in r.snippet.lower() for r in packing.elastic_windows(d, ["needle"], 900).collect())


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    vals = base + [b ^ (1 << rng.randrange(64)) for b in base] + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [0, 0, base[0]]
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    df = spark.createDataFrame(list(enumerate(signed)), "id bigint, simhash bigint")
    want = {(a, b) for a in set(signed) for b in set(signed) if a < b and a and b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {(r.a, r.b) for r in dedup.near_pairs(df).collect()} == want and want
    n = {r.id: (r.n, r.first_key) for r in dedup.classes(df).collect()}
    assert n[0] == (2, 0) and n[len(vals) - 1] == (2, 0)


def test_suppression_merges_tags(spark):
    rows = [(1, 1, 7, ["a"], ["x"], 9.0), (1, 2, 6, ["b"], ["x"], 5.0), (1, 3, 0, ["c"], None, 4.0), (1, 4, 0, ["d"], None, 3.0), (2, 5, 7, None, None, 1.0)]
    df = spark.createDataFrame(rows, "query_id int, id bigint, simhash bigint, tags array<string>, buckets array<string>, score double")
    got = {r.id: r.tags for r in dedup.suppress(df).collect()}
    assert got == {1: ["a", "b"], 3: ["c"], 4: ["d"], 5: None}


def test_bright_edges(spark):
    n = mem(spark, [(1, "", "f", ["x"], ["t"], "i", "p"), (2, "", "f", ["x"], ["t"], "i", "p"), (3, "", "g", ["q"], ["t"], "i", "p"), (9, "", None, None, None, "i", "p")]).withColumn("score", F.lit(1.0))
    got = {(r.from_id, r.to_id): (r.relation, r.strength) for r in graph.bright_edges(n).collect()}
    assert got[1, 2] == ("next_chunk", 18) and got[1, 3] == ("related", 1) and not any(9 in k for k in got)


def test_links(spark):
    us = lambda m: T0 + timedelta(minutes=m)
    s = spark.createDataFrame([(1, us(10)), (2, us(100)), (3, us(5))], "id bigint, ts timestamp")
    o = spark.createDataFrame([(11, us(1)), (12, us(9)), (13, us(10)), (14, us(60)), (15, us(300))], "id bigint, ts timestamp")
    got = {(r.s_id, r.o_id) for r in links.asof_links(s, o, 600).collect()}
    assert got == {(1, 13), (3, 11)}
    linked = spark.createDataFrame([(13,)], "o_id bigint")
    assert {(r.s_id, r.o_id) for r in links.asof_links(s, o, 600, linked).collect()} == {(1, 12), (3, 11)}


def test_jaccard_links_equal_brute_force(spark):
    rng = random.Random(4)
    ws = [f"word{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(ws) for _ in range(n))
    s = [(i, say(60), 120) for i in range(8)]
    o = [(100 + i, say(rng.randint(30, 90))) for i in range(25)] + [(200, s[0][1])]
    got = {r.s_id: (r.o_id, r.score) for r in links.jaccard_links(spark.createDataFrame(s, "id bigint, content string, n_tokens bigint"), spark.createDataFrame(o, "id bigint, content string"), 0.5).collect()}
    want = {}
    for i, t, n in s:
        best = max(((round(len(set(t.split()) & set(u.split())) / len(set(t.split()) | set(u.split())), 6), -k) for k, u in o if max(200, 2 * n) <= len(u) <= int(6.4 * n)), default=(0, 0))
        if best[0] >= 0.5:
            want[i] = (-best[1], best[0])
    assert got == want and got[0][0] == 200


def test_interpolation(spark):
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, datetime(2025, 1, 5)), ("a", 5, None), ("b", 1, None)]
    df = spark.createDataFrame(rows, "s string, p int, t timestamp")
    got = {(r.s, r.p): r.filled_us for r in links.interpolate_dates(df, "s", "p", "t", "2025-01-01", "2025-01-09").collect()}
    day = lambda n: int((datetime(2025, 1, n) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert got == {("a", 1): day(1), ("a", 2): day(3), ("a", 3): day(5), ("a", 5): day(9), ("b", 1): day(1)}


def test_gap_clusters(spark):
    e = spark.createDataFrame([(i, "u", T0 + timedelta(seconds=s)) for i, s in enumerate([0, 900, 1801, 1802, 1802])], "id bigint, u string, ts timestamp")
    assert [r.cluster for r in O.gap_clusters(e, ["u"]).orderBy("id").collect()] == [1, 1, 2, 2, 2]
    assert O.episodes(O.gap_clusters(e, ["u"]), ["u"]).first().n == 3


def test_tables(spark):
    cur = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, v string")
    ch = spark.createDataFrame([(2, "b"), (2, "c"), (3, "d")], "k bigint, v string")
    show = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert show(O.upsert(cur, ch, "k")) == [(1, "a"), (2, "c"), (3, "d")]
    assert len(show(O.insert_only(cur, ch, "k"))) == 3 and show(O.delete_keys(cur, ch, "k")) == [(1, "a")]
    assert show(O.update_column(cur.na.fill("z"), spark.createDataFrame([(1, None)], "k bigint, v string"), "k", "v"))[0] == (1, None)
    assert [r.k for r in O.missing_after_write(ch, cur, "k").collect()] == [3]


def test_quarantine_and_restore(spark):
    m = mem(spark, ROWS[:2])
    q = O.quarantine(m, F.col("id") == 2)
    assert {r.id: r.provenance for r in q.collect()} == {1: "internal", 2: "quarantine"}
    back = {r.id: (r.provenance, r.tags) for r in O.restore(q, F.col("id") == 2).collect()}
    assert back[2] == ("internal", ["t1", "t2"])


def test_dream_of_empty_and_null(spark):
    m = mem(spark, ROWS)
    got = {r.id: r.new_buckets for r in O.dream(m.withColumn("ts", F.when(F.col("id") != 3, F.col("ts")))).collect()}
    assert "2025" in got[1] and "semantic_tag_placeholder" in got[5] and got[3] == ["x"]


def test_mirror(spark):
    m = mem(spark, [(1, "# Title\nbody", "p/a.md", ["box"], ["#z", "#a", "box", "inbox"], "internal", "prose"), (2, "x", None, None, ["#manually_quarantined"], None, "prose")])
    got = {r.id: r.dir for r in m.select("id", mirror.mirror_dir().alias("dir")).collect()}
    assert got == {1: "@box/#a/#z", 2: "@quarantine/#manually_quarantined"}
    docs = mirror.documents(mirror.bundles(m)).collect()
    assert any("## [1] Title" in d.markdown and d.file.startswith("a_md_") for d in docs) and len(docs) == 2


def test_statistics(spark):
    df = spark.createDataFrame([("a", 0.04), ("a", 0.05), ("b", 0.5), ("b", None)], "k string, s double")
    assert {(r.bucket, r.n) for r in S.score_histogram(df, "s").collect()} == {(0.0, 1), (0.05, 1), (0.5, 1)}
    assert [(r.threshold, r.n, r.n_keys) for r in S.at_least(df, "s", [0.05, 0.9], "k").collect()] == [(0.05, 2, 2), (0.9, 0, 0)]


def test_knn_equal_brute_force(spark):
    rng = random.Random(1)
    v = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)] + [(90, [0.0] * 4), (91, [1.0]), (92, None)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.neighbour for r in R.knn(df.where("vec_id < 5"), df, 3, block=2).collect()}

    def cos(a, b):
        if not b or len(a) != len(b):
            return 0.0
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for q, a in v[:5]:
        best = sorted(((-cos(a, b), i) for i, b in v if i != q))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == [i for _, i in best]


def test_files_and_stream(spark, tmp_path):
    root = tmp_path / "in" / "box"
    root.mkdir(parents=True)
    (root / "a.md").write_text("one")
    (root / "b.txt").write_text("two")
    (root / ".hidden.md").write_text("no")
    (root / "c.bin").write_text("no")
    (root / "empty.md").write_text("")
    got = files.bucketed(files.read_files(spark, str(tmp_path / "in")), str(tmp_path / "in")).collect()
    assert {(r.rel_path, r.bucket, r.content) for r in got} == {("box/a.md", "box", "one"), ("box/b.txt", "box", "two")}
    table, ckpt = str(tmp_path / "t"), str(tmp_path / "c")
    first = ingest.run_ingest(spark, str(tmp_path / "in"), table, ckpt)
    assert {r.content for r in first.collect()} == {"one", "two"}
    (root / "d.md").write_text("three")
    again = ingest.run_ingest(spark, str(tmp_path / "in"), table, ckpt)
    assert {r.content for r in again.collect()} == {"one", "two", "three"}
    reg = spark.createDataFrame([(r.path, r.hash, 1) for r in first.collect()], "path string, hash string, last_ingest int")
    assert {r.content for r in files.changed(files.read_files(spark, str(tmp_path / "in")), reg).collect()} == {"three"}
    cut = files.corpus(spark, str(tmp_path / "in"), ["md", "txt"], token_cap=4)
    assert {r.content for r in cut.collect()} == {"one", "two"}
    assert files.newest_snapshot(spark, str(tmp_path)) is None


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, T0 + timedelta(minutes=m), float(m)) for m in (0, 5, 40, 41, 600)] + [(2, T0 + timedelta(minutes=1), 2.0)]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "e"))
    got = {(r.user_id, r.n, r.total) for r in ingest.run_sessions(spark, str(tmp_path / "e"), df.schema, str(tmp_path / "o"), str(tmp_path / "k")).collect()}
    want = {(r.user_id, r.n, r.total) for r in ingest.sessions(df).collect()}
    assert got == want - {(1, 1, 600.0)} and len(got) == 3


def test_combined_yaml_and_records(spark):
    text = "--- START OF FILE: a/x.md ---\nhello\nworld\n--- END OF FILE: a/x.md ---\n--- START OF FILE: y ---\n\n--- END OF FILE: y ---"
    got = {(r.path, r.content) for r in files.split_combined(spark.createDataFrame([(text,), (None,), ("",)], "content string")).collect()}
    assert got == {("a/x.md", "hello\nworld"), ("y", "")}
    _, n = files.import_yaml(spark, "- id: 1\n  content: a\n- id: 2\n- plain\n")
    assert {r.status: r.n for r in n.collect()} == {"imported": 1, "skipped": 1, "error": 1}
    r = files.normalised_records(spark.createDataFrame([("7", "1735786898", "x" * 20)], "uid string, created_at string, body string"), 10).first()
    assert (r.id, r.content, r.ts) == ("7", "x" * 10, datetime(2025, 1, 2, 3, 1, 38))


def test_visible(spark):
    rows = [('{"status": "committed"}', "thinking_content"), ('{"status": "draft", "app_id": "1"}', "x"), ('{"app_id": "1"}', "x"), ('{"app_id": "1", "source": "Prompt_Logs/x"}', "x"), ('{"app_id": "1"}', "[PLANNER] x"), ("{}", "x"), (None, None), ("not json", "x")]
    df = spark.createDataFrame(rows, "m string, c string")
    assert [r.x for r in df.select(R.allowed(df.m, df.c).alias("x")).collect()] == [True, False, True, False, False, False, False, False]


def test_empty_inputs(spark):
    m = mem(spark, [])
    f = R.term_frame(spark, {(1, 1): ["red"]})
    a = R.anchors(m, f, 5)
    assert a.collect() == [] and R.tag_walk(m, a, 5).collect() == []
    assert dedup.near_pairs(m.select("id", K.simhash("content").alias("simhash"))).collect() == []
    assert mirror.bundles(m).collect() == [] and O.dream(m).collect() == []
