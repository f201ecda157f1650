"""Shared text primitives: normalised words and their hashes, k-gram hashes, bounded slices of Arrow batches.

A word is a maximal run of letters and digits (any script) of the lower-cased text. Its hash is the polynomial
``sum(codepoint[i] * BASE ** (n - 1 - i))`` modulo 2**64, which SQL can compute too. All words of a slice are hashed
at once from prefix sums over code points; no Python object is made for a word. A null text counts as an empty one
everywhere: it has no words.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9
TWO64 = 1 << 64
SLICE_CHARS = 400_000


def _letters() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, bool)
    for cp in range(sys.maxunicode + 1):
        table[cp] = unicodedata.category(chr(cp))[0] in "LN"
    return table


_cache: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    if "letters" not in _cache:
        _cache["letters"] = _letters()
    return _cache["letters"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i up to ``n`` at least."""
    if len(_cache.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for key, base in (("up", BASE), ("down", pow(BASE, -1, TWO64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _cache[key] = np.cumprod(steps, dtype=np.uint64)
    return _cache["up"], _cache["down"]


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``chars`` characters; one longer text makes a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each begins (one more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lowered texts, begin and end of every word in them, and the first word of each text."""
    cps, starts = codepoints([t.lower() if t else "" for t in texts])
    inner = letters()[cps]
    edge = np.flatnonzero(np.diff(inner.view(np.int8), prepend=np.int8(0)))
    begin, end = edge[0::2], edge[1::2]  # every text ends with a line feed, so each word that begins also ends
    return cps, begin, end, np.searchsorted(begin, starts)


def span_hashes(cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span of code points (none of them empty)."""
    up, down = powers(len(cps))
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(cps * down[: len(cps)], out=sums[1:])
    return (sums[end] - sums[begin]) * up[end - 1]


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the offsets at which each text begins (one more than texts)."""
    cps, begin, end, first = spans(texts)
    return span_hashes(cps, begin, end), first


def hashed_as_they_are(tokens: list[str]) -> np.ndarray:
    """The same hash of whole tokens, not lowered."""
    cps, starts = codepoints(tokens)
    return span_hashes(cps, starts[:-1], starts[1:] - 1)


def multipliers(k: int) -> list[int]:
    return [pow(BASE, k - 1 - j, TWO64) for j in range(k)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k successive words, without regard to where texts end (see ``inside``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = mixed(h)
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(multipliers(k)):
        out += words[j : j + n] * np.uint64(m)
    return mixed(out)


def inside(first: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` k-grams lie inside one text, and the text of each."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    return np.arange(n) + k <= first[owner + 1], owner


def batches(source: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of Arrow batches, with the texts of column number ``text``."""
    for batch in source:
        texts = batch.column(text).to_pylist()
        for a, b in slices(texts):
            yield batch.slice(a, b - a), texts[a:b]


def longs(h: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's signed longs, bit by bit."""
    return pa.array(h.view(np.int64))


def lists(flat: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


# The same numbers in DuckDB.

_TWO64 = f"{TWO64}::UHUGEINT"


def sql_words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def sql_word_hash(word: str) -> str:
    points = f"list_transform(string_split({word}, ''), lambda c: ord(c)::UHUGEINT)"
    return f"list_reduce({points}, lambda a, c: (a * {BASE}::UHUGEINT + c) % {_TWO64})::UBIGINT"


def sql_mixed(x: str) -> str:
    y = f"((xor({x}, {x} >> 32)::UHUGEINT * {MIX}::UHUGEINT) % {_TWO64})::UBIGINT"
    return f"xor({y}, {y} >> 29)"


def sql_kgram(mixed_words: list[str]) -> str:
    """Equal to ``kgrams`` before its last mixing, given mixed word hashes."""
    total = " + ".join(f"({c}::UHUGEINT * {m}::UHUGEINT) % {_TWO64}" for c, m in zip(mixed_words, multipliers(len(mixed_words))))
    return f"(({total}) % {_TWO64})::UBIGINT"
