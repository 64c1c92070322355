"""Long exact spans shared between records, over a compacted de Bruijn graph.

Tokens of the graph are winnowed k-mers: of every window of ``least - k + 1`` k-mers the one with the least hash is chosen, so
that any two texts with a common span of ``least`` characters choose at least one k-mer in it alike. Texts are first reduced
to distinct ones. Tokens that occur in several texts are the repeated nodes; two neighbours in a text are joined by an edge,
named by a hash of all characters from the first to the end of the second. A node through which all texts come by one edge
and leave by one edge does not branch; runs of such nodes are compacted into one path by a join of the texts' nodes with the
nodes' degrees. A compacted path of at least ``least`` characters is a shared span as it stands. At its ends, and at
every branching node, the characters around the node's source coordinates decide: all spans of ``least`` characters that
hold the node are compared by content among the texts that share it, which gives the exact ends.

64-bit hashes only propose: nodes that two k-mers share by chance, and stretches whose keys agree, are settled by comparing
the characters themselves. Only equal texts, the edges of a compacted path and the stretches of hot nodes are told by
cryptographic digests of their contents (SHA-256, and BLAKE2b of 128 bits) instead of by the contents. Defined results: null, empty and shorter texts share nothing; exact copies share
their whole length; a span that only repeats within its own record is not shared; overlapping spans count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_shared

LEAST, K = 200, 72
#: Characters of a text, or of several, that are handled at once.
SEGMENT = 1 << 18
#: Members of a branching node that one task may compare; a node with more is compared by a distributed aggregate.
HOT = 50_000
#: Stretches that one task compares at once; those of a larger node are compared in slices of their keys.
STRETCHES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(int(_BASE), -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _prefix(c: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any stretch follows."""
    size = 1 << max(10, int(len(c)).bit_length())
    up, _ = _powers(size)
    v = (c.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    out = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(v * up[: len(c)], out=out[1:])
    return out


def grams(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of every stretch of ``k`` characters."""
    if len(c) < k:
        return np.zeros(0, np.uint64)
    h = _prefix(c)
    _, down = _powers(1 << max(10, int(len(c)).bit_length()))
    return _mix((h[k:] - h[:-k]) * down[: len(c) - k + 1])


def _window_min(key: np.ndarray, w: int) -> np.ndarray:
    """Least value of every window of ``w``, from running minima of blocks."""
    n = len(key)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _chosen(c: np.ndarray, ok: np.ndarray | None, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-mers chosen in windows that start where ``ok``."""
    h = grams(c, k)
    w = least - k + 1
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.uint64((1 << 24) - 1)
    best = _window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), w)
    if ok is not None:
        best = best[ok[: len(best)]]
    at = (best & low).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    return at, h[at]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def choose(texts: list[str], least: int = LEAST, k: int = K, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the chosen k-mers of all texts, in order."""
    owners, places, hashes = [], [], []
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not group:
            return
        n = np.array([len(texts[i]) for i in group])
        c = np.concatenate([_points(texts[i]) for i in group])
        first = np.cumsum(n) - n
        ok = np.zeros(len(c), np.int32)  # where a window lies within one text
        np.add.at(ok, first, 1)
        np.add.at(ok, first + n - least + 1, -1)
        at, h = _chosen(c, np.cumsum(ok) > 0, least, k)
        own = np.searchsorted(first, at, side="right") - 1
        owners.append(np.array(group)[own])
        places.append(at - first[own])
        hashes.append(h)
        group.clear()
        held = 0

    for i, t in enumerate(texts):
        if t is None or len(t) < least:
            continue
        if len(t) > 2 * segment:
            flush()
            was = -1
            for s in range(0, len(t) - least + 1, segment):
                at, h = _chosen(_points(t[s : s + segment + least - 1]), None, least, k)
                at, new = at + s, at + s > was
                owners.append(np.full(int(new.sum()), i))
                places.append(at[new])
                hashes.append(h[new])
                was = max(was, int(at[-1])) if len(at) else was
            continue
        group.append(i)
        held += len(t)
        if held >= segment:
            flush()
    flush()
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return cat(owners, np.int64).astype(np.int64), cat(places, np.int64), cat(hashes, np.uint64)


def _columns(b: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [b.column(b.schema.get_field_index(n)) for n in names]


def _tokens(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, text = _columns(b, "cid", "text")
            own, _, h = choose(text.to_pylist(), least, k)
            pairs = np.stack([cid.to_numpy()[own], h.view(np.int64)], 1) if len(own) else np.zeros((0, 2), np.int64)
            # a token that a text repeats counts once
            order = np.lexsort((pairs[:, 1], own))
            pairs, own = pairs[order], own[order]
            once = np.r_[True, (own[1:] != own[:-1]) | (pairs[1:, 1] != pairs[:-1, 1])] if len(own) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[once, 1]), pa.array(pairs[once, 0])], names=["h", "cid"])

    return run


def _keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted (h, cid) whose h another row has too; one row is carried over, however many share it."""
    h0 = c0 = None
    sent = False
    for b in batches:
        if not b.num_rows:
            continue
        h, c = (x.to_numpy() for x in _columns(b, "h", "cid"))
        if h0 is not None:
            h, c = np.r_[h0, h], np.r_[c0, c]
        same = h[1:] == h[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        if sent:  # the carried row went out before
            keep[0] = False
        carried_out = sent
        h0, c0 = h[-1:], c[-1:]
        sent = bool(keep[-1]) or (carried_out and len(h) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(c[keep])], names=["h", "cid"])


def _nodes(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, text, tokens = _columns(b, "cid", "text", "tokens")
            cid, texts, tokens = cid.to_numpy(), text.to_pylist(), tokens.to_pylist()
            own, at, h = choose(texts, least, k)
            h = h.view(np.int64)
            repeated = np.zeros(len(own), bool)
            edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.zeros(1, int)
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                repeated[s:e] = np.isin(h[s:e], np.array(tokens[own[s]], np.int64))
            before, after = np.zeros((2, len(own)), np.int64), np.zeros((2, len(own)), np.int64)
            link = np.flatnonzero(repeated[1:] & repeated[:-1] & (own[1:] == own[:-1])) if len(own) else np.zeros(0, int)
            if len(link):
                parts = zip(own[link].tolist(), at[link].tolist(), (at[link + 1] + k).tolist())
                names = np.frombuffer(b"".join(_name(texts[i][x:y]) for i, x, y in parts), np.int64).reshape(-1, 2).T
                after[:, link] = before[:, link + 1] = names
            r = repeated
            cols = [h[r], *before[:, r], *after[:, r], cid[own[r]], at[r]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "before", "before2", "after", "after2", "cid", "at"])

    return run


def _name(stretch: str) -> bytes:
    """Digest of a stretch's characters."""
    return blake2b(stretch.encode("utf-8", "surrogatepass"), digest_size=16).digest()


FOUND = "cid bigint, s bigint, e bigint, h bigint, members bigint, lead bigint, around string"


def _ends(least: int, k: int):
    """Per text: compacted paths as spans, and the surroundings of nodes that branch or end a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            cid, text, nodes = _columns(b, "cid", "text", "nodes")
            for c, t, ns in zip(cid.to_pylist(), text.to_pylist(), nodes.to_pylist()):
                open_at, inner = None, False
                for n in ns:  # in order of place
                    a = n["at"]
                    if n["through"]:
                        inner = True
                        continue
                    if inner and open_at is not None and a + k - open_at >= least:
                        out.append((c, open_at, a + k, None, None, None, None))
                    open_at, inner = a, False
                    lo = max(0, a + k - least)
                    out.append((c, a, None, n["h"], n["members"], a - lo, t[lo : a + least]))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["cid", "s", "e", "h", "members", "lead", "around"])

    return run


def _around(lead: np.ndarray, texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset from the node, content hash) of every stretch of ``least`` characters in the surroundings."""
    n = np.array([len(t) for t in texts], np.int64)
    c = np.concatenate([_points(t) for t in texts]) if texts else np.zeros(0, np.uint32)
    first = np.cumsum(n) - n
    many = np.maximum(0, n - least + 1)
    row = np.repeat(np.arange(len(texts)), many)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    g = grams(c, least)
    return row, inside - lead[row], g[first[row] + inside] if len(row) else g[:0]


def _verified(row: np.ndarray, off: np.ndarray, twin: np.ndarray, lead: np.ndarray, texts: list[str], least: int) -> np.ndarray:
    """Which stretches (row, offset) have the same characters as their twins' at that offset. Neighbouring offsets with one twin are compared as one."""
    order = np.lexsort((off, twin, row))
    r, t, o = row[order], twin[order], off[order]
    cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (t[1:] != t[:-1]) | (o[1:] != o[:-1] + 1)]) if len(r) else np.zeros(0, int)
    last = np.r_[cut[1:], len(r)] - 1 if len(r) else cut
    good = np.ones(len(r), bool)
    for s, e, a, b, x, y in zip(cut.tolist(), last.tolist(), (lead[r[cut]] + o[cut]).tolist(), (lead[t[cut]] + o[cut]).tolist(), r[cut].tolist(), t[cut].tolist()):
        n = e - s + least
        if texts[x][a : a + n] != texts[y][b : b + n]:
            good[s : e + 1] = [texts[x][a + i : a + i + least] == texts[y][b + i : b + i + least] for i in range(e - s + 1)]
    out = np.empty(len(r), bool)
    out[order] = good
    return out


def _compare(h: np.ndarray, cid: np.ndarray, at: np.ndarray, lead: np.ndarray, texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cid, s, e) of members whose surroundings share a stretch with another text's; rows of whole groups.

    Stretches are grouped by a key of their node, offset and hash; each is then compared, character by character, with one of another
    text in its group. Where that fails, its group is told apart by the characters."""
    slices = max(1, -(-sum(max(0, len(t) - least + 1) for t in texts) // STRETCHES))
    lo, hi = np.full(len(texts), 1 << 40), np.full(len(texts), -(1 << 40))
    for part in range(slices):
        rows, offs, keys = [], [], []
        for i in range(0, len(texts), 4096):
            row, off, g = _around(lead[i : i + 4096], texts[i : i + 4096], least)
            row += i
            key = _mix(g ^ _mix(h[row].view(np.uint64) + (off + least).astype(np.uint64)))
            if slices > 1:
                mine = key % np.uint64(slices) == part
                row, off, key = row[mine], off[mine], key[mine]
            rows.append(row)
            offs.append(off)
            keys.append(key)
        row, off, key = (np.concatenate(x) for x in (rows, offs, keys))
        if not len(row):
            continue
        order = np.lexsort((cid[row], key))
        row, off, ks = row[order], off[order], key[order]
        cs = cid[row]
        new = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
        many = np.diff(np.r_[new, len(ks)])
        first, last = np.repeat(new, many), np.repeat(new + many - 1, many)
        shared = cs[first] != cs[last]
        row_of, off_of = row[shared], off[shared]
        twin = row[np.where(cs == cs[first], last, first)[shared]]
        good = _verified(row_of, off_of, twin, lead, texts, least) & (off_of == off[np.where(cs == cs[first], last, first)[shared]])
        if not good.all():  # different stretches of one key: the groups they are in are told apart by content
            bad = np.isin(first[shared], first[shared][~good])
            owners: dict[tuple, set] = {}
            spot = lambda i: (int(h[row_of[i]]), int(off_of[i]), texts[row_of[i]][lead[row_of[i]] + off_of[i] :][:least])
            for i in np.flatnonzero(bad).tolist():
                owners.setdefault(spot(i), set()).add(int(cid[row_of[i]]))
            good[bad] = [len(owners[spot(i)]) > 1 for i in np.flatnonzero(bad).tolist()]
        np.minimum.at(lo, row_of[good], off_of[good])
        np.maximum.at(hi, row_of[good], off_of[good])
    m = np.flatnonzero(lo <= hi)
    return cid[m], at[m] + lo[m], at[m] + hi[m] + least


def _compare_sorted(least: int):
    """Members sorted by node: whole groups are compared batch by batch, the last group waits until the next node begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[str] = []
        begin = 0  # of the last group, which may have come in many parts

        def emit(n: int) -> pa.RecordBatch:
            nonlocal held, texts
            h, cid, at, lead = (np.concatenate(x) for x in zip(*held))
            got = _compare(h[:n], cid[:n], at[:n], lead[:n], texts[:n], least)
            held, texts = [(h[n:], cid[n:], at[n:], lead[n:])], texts[n:]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["cid", "s", "e"])

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                h, cid, at, lead, around = _columns(part, "h", "cid", "s", "lead", "around")
                cols = tuple(x.to_numpy() for x in (h, cid, at, lead))
                if not texts or held[-1][0][-1] != cols[0][-1]:
                    begin = len(texts) + int(np.searchsorted(cols[0], cols[0][-1]))
                held.append(cols)
                texts += around.to_pylist()
                if begin and len(texts) >= 1024:
                    yield emit(begin)
                    begin = 0
        if texts:
            yield emit(len(texts))

    return run


def _explode(least: int):
    """Every stretch of the members of hot nodes: (g, cid, at, off); g names the node, the offset and the characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                h, cid, at, lead, around = (x.to_pylist() for x in _columns(b.slice(lo, 256), "h", "cid", "s", "lead", "around"))
                out = [(_name(f"{n} {i - e} {t[i : i + least]}"), c, a, i - e) for n, c, a, e, t in zip(h, cid, at, lead, around) for i in range(len(t) - least + 1)]
                cols = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.binary(), *[pa.int64()] * 3))], names=["g", "cid", "at", "off"])

    return run


def shared_spans(docs: DataFrame, least: int = LEAST, k: int = K, hot: int = HOT) -> DataFrame:
    """``docs``: (cid bigint, text), texts distinct. Gives (cid, s, e): spans shared with another text; they may overlap."""
    tokens = docs.mapInArrow(_tokens(least, k), "h bigint, cid bigint")
    repeated = tokens.repartition("h").sortWithinPartitions("h").mapInArrow(_keep_repeated, "h bigint, cid bigint")
    per_text = repeated.groupBy("cid").agg(F.collect_list("h").alias("tokens"))  # bounded by the text's own length
    texts = write_shared(docs.join(per_text, "cid"), "p8_texts")

    # written, so that the join below meets the nodes as they lie: a hot one is split there
    nodes = write_shared(texts.mapInArrow(_nodes(least, k), "h bigint, before bigint, before2 bigint, after bigint, after2 bigint, cid bigint, at bigint"), "p8_nodes")
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    through = one("before") & one("before2") & one("after") & one("after2")
    degrees = nodes.groupBy("h").agg(through.alias("through"), F.count("*").alias("members"))
    placed = nodes.select("h", "cid", "at").join(degrees, "h")
    paths = placed.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("at", "h", "through", "members"))).alias("nodes"))
    ends = write_shared(texts.select("cid", "text").join(paths, "cid").mapInArrow(_ends(least, k), FOUND), "p8_ends")

    member = ends.where("h is not null").select("h", "cid", "s", "lead", "around", "members")
    usual = member.where(F.col("members").between(2, hot)).repartition("h").sortWithinPartitions("h").mapInArrow(_compare_sorted(least), "cid bigint, s bigint, e bigint")
    spans = ends.where("h is null").select("cid", "s", "e").unionByName(usual)
    wide = member.where(F.col("members") > hot)
    if not wide.isEmpty():
        cells = write_shared(wide.mapInArrow(_explode(least), "g binary, cid bigint, at bigint, off bigint"), "p8_cells")
        several = cells.groupBy("g").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("g")
        found = cells.join(several, "g").groupBy("cid", "at").agg(F.min("off").alias("a"), F.max("off").alias("b"))
        spans = spans.unionByName(found.select("cid", (F.col("at") + F.col("a")).alias("s"), (F.col("at") + F.col("b") + least).alias("e")))
    return spans


def covered(spans: DataFrame) -> DataFrame:
    """(cid, n): characters in the union of a text's spans."""
    by = spans.groupBy("cid").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("x"))
    zero = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc.to, x.e).alias("to"), (acc.n + F.greatest(F.lit(0).cast("bigint"), x.e - F.greatest(acc.to, x.s))).alias("n"))
    return by.select("cid", F.aggregate("x", zero, step)["n"].alias("n"))


def shared_chars(docs: DataFrame, key: str, text: str, least: int = LEAST, k: int = K, hot: int = HOT) -> DataFrame:
    """(key, shared_chars) of the records that share a span of at least ``least`` characters with another record."""
    long = docs.where(F.length(text) >= least).select(F.col(key).alias("key"), F.col(text).alias("text"), F.sha2(text, 256).alias("digest"), F.length(text).cast("bigint").alias("size"))
    distinct = long.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # numbered when written, so that a number is of one text whatever is run again
    distinct = write_shared(distinct.withColumn("cid", F.monotonically_increasing_id()), "p8_distinct")
    cover = covered(shared_spans(distinct.select("cid", "text"), least, k, hot))
    known = distinct.select("digest", "cid", "copies").join(cover, "cid", "left").where("copies > 1 or n > 0").select("digest", "copies", "n")
    chars = F.when(F.col("copies") > 1, F.col("size")).otherwise(F.col("n"))
    return long.select("key", "digest", "size").join(known, "digest").select(F.col("key").alias(key), chars.alias("shared_chars"))
