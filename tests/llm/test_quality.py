from __future__ import annotations

import pytest

from palimpsest.llm import quality as Q

PROSE = [
    "The old pump was replaced before lunch, and nobody has complained about it since then. We should write that down.",
    "Das Protokoll der Sitzung wurde gestern Abend gekürzt, weil die Uhr falsch ging und niemand es gemerkt hatte.",
    "La lista de palabras movió la página de ajustes tal como habíamos previsto, y nadie se ha quejado.",
    "Le rapport du puits a été corrigé pendant la nuit, mais les chiffres ne collent pas encore avec la liste.",
    "please look at the sensor feed it was repeated because of a missing comma and i think it should be fixed this week",
    "THE REVIEW WAS MOVED BY THE TEAM WHILE NOBODY WAS LOOKING, SO WE WILL HAVE TO CHECK IT AGAIN.",
]
NATIVE = [
    "\u0412\u0447\u0435\u0440\u0430 \u043c\u044b \u0434\u043e\u043b\u0433\u043e \u0433\u043e\u0432\u043e\u0440\u0438\u043b\u0438 \u043e \u043d\u043e\u0432\u043e\u043c \u0433\u0440\u0430\u0444\u0438\u043a\u0435, \u0438 \u043d\u0438\u043a\u0442\u043e \u043d\u0435 \u0437\u043d\u0430\u043b, \u0447\u0442\u043e \u043d\u0430\u0441\u043e\u0441 \u0443\u0436\u0435 \u0437\u0430\u043c\u0435\u043d\u0438\u043b\u0438. \u0417\u0430\u0432\u0442\u0440\u0430 \u044f \u043d\u0430\u043f\u0438\u0448\u0443 \u043e\u0431 \u044d\u0442\u043e\u043c.",
    "\u6628\u5929\u6211\u4eec\u8ba8\u8bba\u4e86\u65b0\u7684\u65f6\u95f4\u8868\uff0c\u6ca1\u6709\u4eba\u77e5\u9053\u6cf5\u5df2\u7ecf\u88ab\u66f4\u6362\u4e86\u3002\u660e\u5929\u6211\u4f1a\u628a\u8fd9\u4ef6\u4e8b\u5199\u4e0b\u6765\u3002",
    "\u6628\u65e5\u306f\u65b0\u3057\u3044\u4e88\u5b9a\u8868\u306b\u3064\u3044\u3066\u9577\u3044\u9593\u8a71\u3057\u307e\u3057\u305f\u3002\u30dd\u30f3\u30d7\u304c\u3082\u3046\u4ea4\u63db\u3055\u308c\u305f\u3053\u3068\u3092\u8ab0\u3082\u77e5\u308a\u307e\u305b\u3093\u3067\u3057\u305f\u3002",
    "\u03a7\u03b8\u03b5\u03c2 \u03bc\u03b9\u03bb\u03ae\u03c3\u03b1\u03bc\u03b5 \u03b3\u03b9\u03b1 \u03c4\u03bf \u03bd\u03ad\u03bf \u03c0\u03c1\u03cc\u03b3\u03c1\u03b1\u03bc\u03bc\u03b1 \u03ba\u03b1\u03b9 \u03ba\u03b1\u03bd\u03b5\u03af\u03c2 \u03b4\u03b5\u03bd \u03ae\u03be\u03b5\u03c1\u03b5 \u03cc\u03c4\u03b9 \u03b7 \u03b1\u03bd\u03c4\u03bb\u03af\u03b1 \u03b5\u03af\u03c7\u03b5 \u03b1\u03bb\u03bb\u03ac\u03be\u03b5\u03b9.",
    "\u062a\u062d\u062f\u062b\u0646\u0627 \u0623\u0645\u0633 \u0639\u0646 \u0627\u0644\u062c\u062f\u0648\u0644 \u0627\u0644\u062c\u062f\u064a\u062f \u0648\u0644\u0645 \u064a\u0639\u0631\u0641 \u0623\u062d\u062f \u0623\u0646 \u0627\u0644\u0645\u0636\u062e\u0629 \u0642\u062f \u0627\u0633\u062a\u0628\u062f\u0644\u062a \u0645\u0646 \u0642\u0628\u0644.",
]
#: Without sense: other scripts in a list, as text misread in UTF-16, and in one heap.
ALIEN = [
    "\u041d\u0430\u0441\u043e\u0441 / \u0413\u0440\u0430\u0444\u0438\u043a / \u041e\u0447\u0435\u0440\u0435\u0434\u044c / \u0421\u0442\u0440\u0430\u043d\u0438\u0446\u0430 / \u0414\u043e\u0441\u044c\u0435 / \u041f\u0440\u043e\u0442\u043e\u043a\u043e\u043b / \u0421\u043f\u0438\u0441\u043e\u043a / \u0417\u0430\u043c\u0435\u0442\u043a\u0430",
    ("The pump was replaced before lunch, and nobody has complained about it since then, as we had said. " * 2).encode().decode("utf-16-le"),
    "\u0142\u6587\u03bb_\u7bc0eg/\u044f \u6587\u7bc0\u0119\u03c0 i\u0107\u0105\u03c0u e\u0105_\u0436\u5b57\u0119\u0436 b\u5217:\u03c3\u03bb\u7bc0di /\u0107\u6bb5i\u0449 e\u015b\u884co\u0449\u03c0 \u4e2d\u0144\u0449",
]
OTHER = [
    "| queue | 23690 | BPD | 530.95 |\n| page | 41016 | rpm | 858.76 |\n| split | 24974 | ms | 201.36 |",
    "const a = lock.rank(8594); for (let i = 0; i < page.length; i++) { fold.push(page[i] ^ 0x2fd9); }",
    '{"buf_edge228": [], "tokSegWalk": true, "rowEmit40": [], "gateIdx93": 4475, "frag_graph82": null}',
    "2025-09-16 03:41:28.250 INFO [diff_shard587] queueCell66=10602 tag=381857ec took 6184 ms",
    "to be or, to be or, to be or, to be or, to be or, to be or, to be or, to be or, to be or, to be or,",
    "Plan / Log / Memo / Watcher / Board / Outline / Plan / Node / Queue / Record / Comment / Form",
    "00000000  70 b9 d0 7d d9 ed 4d 75 33 7f bf 96 88 14 4e 01\n00000010  0a b9 d0 7d d9 ed 4d 75 33 7f bf 96",
    '<li class="unit" id="d133">758</li><li class="cell" id="4eb4">988</li><li class="x" id="78c0">243</li>',
    "🧠 🛠tok 😀😀🧠 🔧row 🔥edge 🚀lock 🛠 📝😀🔥val ⚠✨🚀key 📌🌱📝 📌✅ 🎯 🔥",
    "247.8ms 660.614 541.0120ms 111.006 90.608 738.82, 945.4978ms 820.9 224, 731, 686mm 588.99",
]
SCHEMA = "eid string, text string, words string, fired string, n_chars string"


def frame(spark, texts):
    return spark.createDataFrame([(str(i), t, "a", "b", "c") for i, t in enumerate(texts)], SCHEMA).select("eid", "text")


@pytest.mark.parametrize("times", [1, 20])
def test_held_out_texts(spark, times):
    got = {r.eid: r for r in Q.verdicts(frame(spark, (PROSE + OTHER) * times)).collect()}
    n = len(PROSE + OTHER)
    wrong = [i for i in range(n * times) if got[str(i)].is_prose != (i % n < len(PROSE))]
    assert not wrong


@pytest.mark.parametrize("times", [1, 10])
def test_prose_of_other_scripts(spark, times):
    """Among the usual texts, which are the ones EM learns from."""
    base = (PROSE + OTHER) * 10
    texts = base + (NATIVE + ALIEN) * times
    got = {r.eid: r for r in Q.verdicts(frame(spark, texts)).collect()}
    verdicts = [got[str(len(base) + i)].is_prose for i in range(len(NATIVE + ALIEN))]
    assert verdicts == [True] * len(NATIVE) + [False] * len(ALIEN)
    assert all(got[str(i)].is_prose == (i % len(PROSE + OTHER) < len(PROSE)) for i in range(len(base)))


def test_control_characters_part_no_words():
    got = Q.statistics(["a\x1cb c\x85d", "", "\ud800 x"])
    assert got["n_words"].tolist() == [3, 0, 2] and got["n_chars"].tolist() == [7, 0, 3]


def test_null_blank_odd_and_long(spark):
    texts = [None, "", " \n  ", "=" * 80, "x", "word " * 20_000, "The end of it was as we had said. " * 2 + "And then the others were there, too."]
    got = {r.eid: r for r in Q.verdicts(frame(spark, texts)).collect()}
    assert set(got) == {"3", "4", "5", "6"}
    assert not got["3"].is_prose and not got["5"].is_prose


def test_no_rows(spark):
    assert Q.verdicts(frame(spark, [])).collect() == []
    assert Q.learn([])[0] == {}


def test_statistics(spark):
    r = Q.with_statistics(frame(spark, ["The cat sat. On the mat!\nno end here\n"])).first()
    assert (r.n_words, r.n_lines) == (9, 2)
    assert r.ended_lines == 0.5 and r.symbol_ratio == 0 and abs(r.mean_word_length - 28 / 9) < 1e-9


def test_em_follows_agreement():
    prose, junk = 0b0111, 1 << Q.FUNCTIONS.index("loops") | 1 << Q.FUNCTIONS.index("repeats") | 0b11
    post, rate = Q.learn([(prose, 900), (junk, 60), (0, 40)])
    assert post[prose][0] > 0.99 and post[junk][0] < 0.1
    assert rate[0, Q.FUNCTIONS.index("loops")] <= 0.002


def test_p3_on_the_tables(spark, sf):
    from palimpsest.llm import queries as q

    s = q.p3_statistics(spark, sf).toPandas()
    found = {(r.src_table, r.eid) for r in q.p3_found(spark, sf).collect()}
    assert found == {(a, b) for a, b, p in zip(s.src_table, s.eid, s.p_prose) if p < 0.5}
    assert 0.2 < len(found) / len(s) < 0.7
