"""Kernels that carry state over a text: Arrow-batched pandas UDFs."""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "r": ""}
_ESCAPE = re.compile(r"\\(.?)", re.S)
# Code-point ranges of drawn symbols, and notes of cut texts.
_SYMBOLS = re.compile("[─-➿\U0001f300-\U0001f6ff\U0001f900-\U0001f9ff]|\\[Truncated\\]|\\[\\.\\.\\.\\]")
_FENCE = re.compile(r"```.*?```", re.S)
_META = re.compile(r'"(?:type|timestamp|source)"\s*:\s*"[^"]*",?|"(?:response_content|thinking_content|content)"\s*:\s*')
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def unescape(text: str) -> str:
    """One pass over escapes; an unknown one stays, a lone backslash at the end goes; drawn symbols go."""
    flat = _ESCAPE.sub(lambda m: _ESCAPES.get(m[1], m[0] if m[1] else ""), text)
    return _SYMBOLS.sub("", flat)


def unwrap(text: str) -> str:
    """JSON wrappers around content removed outside fenced code."""
    out, at = [], 0
    flat = unescape(text)

    def outside(s: str) -> str:
        return re.sub(r"\}\s*,\s*\{", "\n\n", _META.sub("", s))

    for m in _FENCE.finditer(flat):
        out += [outside(flat[at : m.start()]), m[0]]
        at = m.end()
    joined = "".join([*out, outside(flat[at:])]).strip()
    if joined[:1] == "[" and joined[-1:] == "]":
        joined = joined[1:-1]
    return re.sub(r"\\{2,}", "/", joined)


def _python(pattern: str) -> re.Pattern:
    """A pattern of the fixed lists, which are written for the JVM, with the JVM's meaning of its classes."""
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern).replace(".*?", "[^\n\r\x85\u2028\u2029]*?"), re.A)


#: Each cleaning step with texts that a match must hold: where one is missing, the pattern isn't tried.
_NEEDED = (("\ufeff",), ("\0", "\ufffd"), ("\r\n",), ("'...",), ("-",), ("[",), ("%",), ("\n\n\n",), ("@",), (".",), ("sk-",))
_STEPS = tuple((_python(p), to, need) for (p, to), need in zip((*X.NOISE, *X.PERSONAL), _NEEDED, strict=True))
_OBJECT = re.compile(r"\{[\s\S]*?\}")
_WHITE = " \t\n\x0b\f\r"


def _wrapped(text: str) -> str:
    """Texts of the flat JSON objects in a text, each followed by a blank line; the text itself if there are none."""
    found = []
    for m in _OBJECT.finditer(text):
        try:
            x = json.loads(m[0], strict=False)
        except ValueError:
            continue
        if (got := next((x[k] for k in X.JSON_FIELDS if isinstance(x.get(k), str) and x[k]), None)) is not None:
            found.append(got)
    return "\n\n".join(found) + "\n\n" if found else text


def sanitized(text: str | None, path: str | None) -> str | None:
    """The cleaning pipeline: noise, personal data, JSON wrappers, outer white space."""
    if text is None:
        return None
    for pattern, to, need in _STEPS:
        if any(n in text for n in need):
            text = pattern.sub(to, text)
    path = path or ""
    log = path.endswith(".json") or ('":' in text and path.rpartition(".")[2].lower() not in X.CODE_EXT and any(k in text for k in ('"response_content":', '"thinking_content":', '"message":', '"content":')))
    return (unwrap(_wrapped(text)) if log else text).strip(_WHITE)


def peel(text: str, most: int = 3) -> str:
    """Escapes undone again and again, as of text that was quoted several times; at most ``most`` passes, symbols stay."""
    for _ in range(most):
        flat = _ESCAPE.sub(lambda m: _ESCAPES.get(m[1], m[0] if m[1] else ""), text)
        if flat == text:
            break
        text = flat
    return text


def _each(fn):
    return lambda s: s.map(lambda x: None if x is None else fn(x))


sanitize = F.pandas_udf(lambda texts, paths: pd.Series([sanitized(t, p) for t, p in zip(texts, paths)]), T.StringType())
cleanse = F.pandas_udf(_each(unescape), T.StringType())
peeled = F.pandas_udf(_each(peel), T.StringType())
strip_wrappers = F.pandas_udf(_each(unwrap), T.StringType())

PIECES = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def sentences(text: str, base: int = 0) -> list[tuple[str, int, int]]:
    """Sentences with their places; the gaps between them are in none."""
    out, at = [], 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out.append((text[at:end], base + at, base + end))
        at = m.end() if m else end
    return out


def rows(text: str) -> list[tuple[str, int, int]]:
    """Lines that aren't blank, with their places."""
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\n]+", text) if m[0].strip()]


def blocks(text: str) -> list[tuple[str, int, int]]:
    """Code blocks: up to the line that closes the outermost brace, or a blank line outside braces."""
    out, start, depth = [], 0, 0
    at = 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        was, at = depth, at + len(line)
        depth += line.count("{") - line.count("}")
        closed = depth == 0 and was > 0
        gap = depth == 0 and not line.strip() and text[start:at].strip()
        if closed or gap:
            out.append((text[start:at], start, at))
            start = at
    if text[start:].strip():
        out.append((text[start:], start, len(text)))
    return out


def fenced(text: str) -> list[tuple[str, int, int]]:
    """Markdown: sentences between code fences, and each fence as it is."""
    out, at = [], 0
    for m in _FENCE.finditer(text):
        out += sentences(text[at : m.start()], at)
        out.append((m[0], m.start(), m.end()))
        at = m.end()
    return out + sentences(text[at:], at)


def pieces(text: str | None, kind: str, markdown: bool = False) -> list[dict]:
    if not text:
        return []
    how = fenced if markdown else {"code": blocks, "data": rows}.get(kind, sentences)
    return [{"content": c, "start": s, "end": e} for c, s, e in how(text)]


@F.pandas_udf(PIECES)
def split_text(text: pd.Series, kind: pd.Series, markdown: pd.Series) -> pd.Series:
    """Pieces of a text by its type, with code-point places into the text."""
    return pd.Series([pieces(t, k, bool(m)) for t, k, m in zip(text, kind, markdown)])


def chunk_prose(text: str, target: int = 600, most: int = 1500) -> list[str]:
    """Chunks that end at a sentence or paragraph end once ``target`` is reached, at ``most`` at the latest."""
    out, start = [], 0
    end = re.compile(r"\n(?=\n)|[.!?](?=[ \n])")
    while start < len(text):
        m = end.search(text, start + target)
        cut = min(m.start() if m else len(text), start + most)
        if cut >= len(text):
            break
        stop = cut + 1 + (text[cut : cut + 2] == "\n\n")
        out.append(text[start:stop])
        start = stop
    return [*out, text[start:]] if start < len(text) else out


def chunk_code(text: str, least: int = 200, most: int = 4000, back: int = 200) -> list[str]:
    """Chunks that end at a line end outside braces past ``least``; at ``most`` at a line end not far back, or anywhere."""
    out, start, depth = [], 0, 0
    for i, ch in enumerate(text):
        depth += ch == "{"
        depth -= ch == "}" and depth > 0
        n = i - start
        if ch == "\n" and depth == 0 and n > least:
            out.append(text[start : i + 1])
            start = i + 1
        elif n >= most:
            line = text.rfind("\n", max(start + 1, i - back + 1), i + 1)
            stop = line + 1 if line > 0 else i + 1
            out.append(text[start:stop])
            start = stop
    return [*out, text[start:]] if start < len(text) else out


def chunk_paragraphs(text: str, most: int = 4000) -> list[str]:
    """Paragraphs packed in order up to ``most`` characters; a longer one stands alone."""
    out: list[str] = []
    for p in text.split("\n\n") if text else []:
        if out and len(out[-1]) + 2 + len(p) <= most:
            out[-1] += f"\n\n{p}"
        else:
            out.append(p)
    return out


def chunk_overlapping(text: str, size: int = 512, overlap: int = 64) -> list[str]:
    """Windows of ``size`` tokens (four characters each) that overlap; a line end past the middle is preferred. Ends at the text's end."""
    width, step_back, out, start = size * 4, overlap * 4, [], 0
    while start < len(text):
        end = min(len(text), start + width)
        if end < len(text) and (line := text.rfind("\n", start + width // 2, end)) > start:
            end = line
        out.append(text[start:end])
        if end >= len(text):
            break
        start = max(start + 1, end - step_back)
    return out


def chunker(fn):
    return F.pandas_udf(lambda s: s.map(lambda x: [] if x is None else fn(x)), T.ArrayType(T.StringType()))


# Constants of the 64-bit FNV-1a hash.
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(words: list[bytes]) -> np.ndarray:
    """FNV-1a of many words at once; bytes are sign-extended before they are mixed in."""
    n = np.array([len(w) for w in words])
    h = np.full(len(words), FNV_START, np.uint64)
    flat = np.frombuffer(b"".join(words), np.int8).astype(np.int64).view(np.uint64)
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        for i in range(int(n.max()) if len(n) else 0):
            on = n > i
            h[on] = (h[on] ^ flat[first[on] + i]) * np.uint64(FNV_PRIME)
    return h


_BLANK = re.compile(rb"[ \n\t\r]")
#: Words whose bits are summed at once.
_AT_ONCE = 1 << 18


def simhashes(texts: list[str | None]) -> list[int | None]:
    """Fingerprints of many texts: distinct words are hashed once, all at a time."""
    known: dict[bytes, int] = {}
    out: list[int | None] = [None] * len(texts)
    sizes: list[int] = []
    owner: list[int] = []
    at: list[int] = []

    def flush() -> None:
        if not owner:
            return
        bits = np.unpackbits(fnv1a(list(known)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits[np.array(at)], np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
        prints = np.packbits(2 * ones > np.array(sizes)[:, None], axis=1, bitorder="little").view(np.int64).ravel()
        for i, v in zip(owner, prints.tolist()):
            out[i] = v
        for x in (known, sizes, owner, at):
            x.clear()

    for i, t in enumerate(texts):
        if t is None:
            continue
        words = [w for w in _BLANK.split(t.encode("utf-8", "surrogatepass")) if w]
        if not words:
            out[i] = 0
            continue
        owner.append(i)
        sizes.append(len(words))
        at += [known.setdefault(w, len(known)) for w in words]
        if len(at) >= _AT_ONCE:
            flush()
    flush()
    return out


def simhash_of(text: str | None) -> int | None:
    return simhashes([text])[0]


simhash = F.pandas_udf(lambda s: pd.Series(simhashes(s.tolist()), dtype="Int64"), T.LongType())


#: Falling powers of 31, modulo 2**32, down to 1.
_POWERS31 = np.multiply.accumulate(np.r_[np.uint32(1), np.full((1 << 16) - 1, 31, np.uint32)])[::-1].copy()


def rolling31(text: str) -> str:
    """The 31-multiplier 32-bit rolling hash over the UTF-16 units of a whole text, in signed hexadecimal."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    h, step = 0, 1 << 16
    for i in range(0, len(units), step):
        part = units[i : i + step]
        h = (h * pow(31, len(part), 1 << 32) + int((part * _POWERS31[step - len(part) :]).sum(dtype=np.uint32))) & 0xFFFFFFFF
    return format(h - (1 << 32) if h >> 31 else h, "x")


fallback_hash = F.pandas_udf(_each(rolling31), T.StringType())
app_id = F.pandas_udf(_each(lambda x: str(uuid.uuid5(uuid.NAMESPACE_URL, x))), T.StringType())


def multiset_similarity(a: str, b: str) -> float:
    """Twice the common characters over all characters."""
    from collections import Counter

    both = sum((Counter(a) & Counter(b)).values())
    return 2 * both / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else multiset_similarity(x, y) for x, y in zip(a, b)])
