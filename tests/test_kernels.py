from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import kernels as K
from palimpsest.functions import query as Q
from palimpsest.functions import text as X
from palimpsest.sources.files import flat_yaml, indent_format, parse_page, yaml_lines


def one(spark, value, make, schema="c string"):
    df = spark.createDataFrame([value if isinstance(value, tuple) else (value,)], schema)
    return df.select(make(df).alias("x")).first().x


def test_unescape():
    assert K.unescape(r"a\nb\tc") == "a\nb\tc"
    assert K.unescape(r"say \"hi\"") == 'say "hi"'
    assert K.unescape("a\\\\b\\") == "a\\b"
    assert K.unescape("x\\r\\q [Truncated]│🙂") == "x\\q "


def test_unwrap_keeps_fences():
    text = '[{"type": "x", "content": "hello"},{"content": "```\\n\\"type\\": \\"kept\\"\\n```"}]'
    out = K.unwrap(text)
    assert "hello" in out and '"type": "kept"' in out and '"type": "x"' not in out


def test_sentence_places():
    text = "First one here. Second one!  Third? no split"
    got = K.sentences(text)
    assert [text[s:e] for _, s, e in got] == [c for c, _, _ in got] == ["First one here.", "Second one!", "Third? no split"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. {}\n`!|é🙂", max_size=80), st.sampled_from(["prose", "code", "data"]), st.booleans())
def test_places_give_back_contents(text, kind, md):
    for p in K.pieces(text, kind, md):
        assert text[p["start"] : p["end"]] == p["content"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n{}!", max_size=700))
def test_chunks_join_to_the_text(text):
    assert "".join(K.chunk_prose(text, 60, 150)) == text
    assert "".join(K.chunk_code(text, 20, 200, 20)) == text
    assert all(len(x) <= 153 for x in K.chunk_prose(text, 60, 150))
    assert "\n\n".join(K.chunk_paragraphs(text, 100)) == text


def test_overlapping_ends():
    out = K.chunk_overlapping("x" * 5000, 128, 16)
    assert out[0] == "x" * 512 and "".join(dict.fromkeys(out)) and sum(map(len, out)) >= 5000
    assert K.chunk_overlapping("") == []


def test_code_blocks():
    text = "function a() {\n  b();\n}\nconst x = 1;\n\nfunction c() {\n}\n"
    assert [c for c, _, _ in K.blocks(text)] == ["function a() {\n  b();\n}\n", "const x = 1;\n\n", "function c() {\n}\n"]


def test_fission():
    text = "Before it. After it.\n```\ncode {\n```\nLast one."
    assert [c for c, _, _ in K.fenced(text)] == ["Before it.", "After it.\n", "```\ncode {\n```", "\nLast one."]


def fnv(word: bytes) -> int:
    h = K.FNV_START
    for b in word:
        h = ((h ^ (b - 256 if b > 127 else b) & (2**64 - 1)) * K.FNV_PRIME) & (2**64 - 1)
    return h


def brute_simhash(text):
    import re

    votes = [0] * 64
    for w in re.split(rb"[ \n\t\r]+", text.encode()):
        if w:
            for i in range(64):
                votes[i] += 1 if fnv(w) >> i & 1 else -1
    v = sum(1 << i for i in range(64) if votes[i] > 0)
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("text", ["", "a", "the quick brown fox", "déjà vu naïve", "a a a b", "x\ty\r\nz"])
def test_simhash(text):
    assert K.simhash_of(text) == brute_simhash(text)


def test_simhash_of_near_texts():
    d = lambda a, b: ((K.simhash_of(a) ^ K.simhash_of(b)) & (2**64 - 1)).bit_count()
    a = "the quick brown fox jumps over the lazy dog again and again until it rests"
    assert d(a, a + ".") < 20 and d(a, a) == 0 and d(a, "x y") == d("x y", a)
    assert K.simhash_of(None) is None


def test_types_and_numbers(spark):
    kind = lambda t, p: one(spark, (t, p), lambda d: X.molecule_type(d.c, d.p), "c string, p string")
    assert [kind("a,b", "x.csv"), kind("let", "x.ts"), kind("| a | b |", "x.md"), kind("import os", "x.md"), kind("functional words", "x.md"), kind("```x```", "x.txt")] == ["data", "code", "data", "code", "prose", "code"]
    n = lambda t: one(spark, t, lambda d: X.numeric(d.c))
    assert tuple(n("| Well | 1500 PSI |")) == (1500.0, "PSI")
    assert tuple(n("in 1999 about 2,500.5 of 7")) == (7.0, None) or tuple(n("in 1999 about 2,500.5 of 7"))[0] == 2500.5
    assert n("nothing") is None and n("in 1999") == n("in 1999")
    assert n(None) is None


def test_system_tags(spark):
    tags = one(spark, "C:/Users/me/Projects/MyProject/src/utils/helper.ts", lambda d: X.system_tags(d.c))
    assert tags == ["#project:MyProject", "#src", "#code"]
    assert one(spark, "x/history/a.md", lambda d: X.system_tags(d.c)) == ["#Archive", "#doc"]


def test_masks_and_noise(spark):
    out = one(spark, ("﻿Processing 'a.ts'...\r\n\n\n\n2025-01-01 10:00:00 - mail a@b.co at 10.1.2.3 [2025-01-01 x] [===] 50%", "a.md"), lambda d: X.sanitize(d.c, d.p), "c string, p string")
    assert "Processing" not in out and "[EMAIL_REDACTED] at [IP_REDACTED]" in out and "50%" not in out and "\n\n\n" not in out
    js = one(spark, ('{"content": "one", "x": 1} {"message": "two"} {bad', "a.json"), lambda d: X.sanitize(d.c, d.p), "c string, p string")
    assert js == "one\n\ntwo"


@pytest.mark.parametrize("fn", [X.token_soup, X.json_like, X.html_like, X.technical_signal, X.suspect])
def test_flags_of_null_and_empty_are_false(spark, fn):
    assert one(spark, None, lambda d: F.coalesce(fn(d.c), F.lit(False))) is False
    assert one(spark, "", lambda d: fn(d.c)) is False


def test_soup(spark):
    soup = lambda t: one(spark, t, lambda d: X.token_soup(d.c))
    assert soup("This is a normal sentence, with words and nothing strange in it at all.") is False
    assert soup("memcpy(dst, src); 0xdeadbeef00 {a:1} [x] foo(bar) baz(qux) <tag> a=b;") is True
    rest = one(spark, "call memcpy(a, b) 0xdeadbeef readable words", lambda d: X.strip_soup(d.c))
    assert "memcpy" not in rest and "0xdead" not in rest and "readable words" in rest


def test_entities_and_dates(spark):
    assert one(spark, "Alice met Bob Smith. alice and Alice saw v1.2.3", lambda d: X.entities(d.c)) == ["v1.2.3", "Alice", "Bob Smith"]
    day = lambda t: one(spark, t, lambda d: F.date_format(X.content_date(d.c), "yyyy-MM-dd"))
    assert [day("on 2025-03-04 it"), day("on 3/4/2025"), day("Mar 4, 2025"), day("2025-13-40"), day("none"), day(None)] == ["2025-03-04"] * 3 + [None] * 3


def test_query_understanding():
    from datetime import date

    today = date(2026, 2, 1)
    assert Q.fts("What's up, Doc?!") == "what s up doc"
    assert Q.temporal("notes of the last 2 years and 2021", today) == ["2026", "2025", "2024", "2021"]
    assert Q.temporal("last 3 months", today) == ["2026", "2025"] and Q.temporal("last 5 days", today) == ["2026"]
    assert Q.keywords("What was the pressure of the queue?", today) == ["pressure", "queue"]
    assert Q.keywords("the of", today) == ["the", "of"]
    assert Q.strategies("tell me about Bob in Denver", today) == [["bob", "denver"], ["denver"]]
    assert Q.molecules("One two, three. " + "w " * 20) == ["One two", "three.", " ".join("w" * 15), " ".join("w" * 5)]
    assert Q.parse('find "exact words" @2024 #box now') == {"phrases": ["exact words"], "temporal": ["2024"], "buckets": ["box"], "keywords": ["find", "now"]}
    assert Q.scope("a #known b #tag", {"known"}) == ("a b", ["known"], ["tag"])
    assert Q.sizes(4000) == (5, 4, 2) and Q.wants_recent("the latest") and not Q.wants_recent("old")
    assert Q.expand("about Pumps and x", ["pump", "y"]) == ["pump"] and Q.entities("pump the pump valve") == ["pump", "valve"]


def test_pages():
    html = "<html><head><title> A &lt;b&gt; </title><meta name='description' content='D'><style>p{}</style><script>if (a<b) '</p>'</script></head><body><nav>menu</nav><article><h2>Head</h2><p>One &amp; two</p><ul><li>x</li></ul></article><footer>foot</footer></body></html>"
    p = parse_page(html)
    assert p["title"] == "A <b>" and p["description"] == "D"
    assert "if (a" not in p["text"] and "p{}" not in p["text"] and "One & two" in p["text"]
    assert p["markdown"].startswith("## Head") and "- x" in p["markdown"] and "menu" not in p["markdown"] and "foot" not in p["markdown"]
    assert parse_page(None)["text"] == "" and parse_page("<p>a<p>b")["text"] == "a b"


def test_yaml_and_indent():
    rows = [{"id": "1", "content": 'a "q"\nb: c', "note": None}, {"id": "2", "content": "é", "note": "x"}]
    assert flat_yaml("\n".join(yaml_lines(iter(rows)))) == [{"id": "1", "content": 'a "q"\nb: c', "note": ""}, {"id": "2", "content": "é", "note": "x"}]
    assert indent_format({"a": {"b": 1}, "c": [1, {"d": 2}]}) == "a:\n  b: 1\nc:\n  - 1\n  -\n    d: 2"


def test_multiset_similarity():
    assert K.multiset_similarity("abc", "abd") == pytest.approx(2 / 3) and K.multiset_similarity("", "") == 1.0
    assert K.rolling31("a") == format(97, "x") and K.rolling31("") == "0"
