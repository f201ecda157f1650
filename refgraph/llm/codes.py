"""Operator 9: token ids as directly addressable codes.

A text is tokenised with a public byte-level vocabulary (its file is a parameter) and its ids are stored as one binary value.
Every id is split into chunks, lowest bits first, one for each level; a level holds the chunks of those ids that reach it,
bit-packed. A continuation bitmap for each level but the last tells which of its ids go on to the next, and a rank
directory holds the number of set bits before every block of ``BLOCK`` bits. The place of an id in the next level is the
rank of its bit, so any token is read by a few byte reads, without decoding what is around it (``token_at``). The chunk
widths of a document are the cheapest of all splits of its widest id into at most ``LEVELS`` levels.

Layout, little-endian: count u32, levels u8, a width u8 for each level; then for each level its count u32, the packed chunks,
and (but for the last) the bitmap and the directory of u32.

One pass over the scan, nothing is shuffled; the broadcast vocabulary has a fixed size. Defined cases: a null text has a null
code and null tokens; an empty one has 0 tokens and a code of its own. Special tokens' names in a text are ordinary text. Ids
may be null or repeat: every row gives a row. A very long text is one code, read at any place alike. Of equally cheap splits the
one with the fewest levels is taken, then the one with the lesser first width. Other columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refgraph.llm import text as tx

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEVELS = 3
BLOCK = 512

_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file's content, built once in a process."""
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def splits(bits: int, levels: int = LEVELS) -> list[tuple[int, ...]]:
    """All ways to cut ``bits`` into at most ``levels`` widths."""
    return [tuple(np.diff([0, *cut, bits]).tolist()) for n in range(levels) for cut in itertools.combinations(range(1, bits), n)]


_costs: dict[int, tuple[list[tuple[int, ...]], np.ndarray]] = {}


def widths(ids: np.ndarray) -> tuple[int, ...]:
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if bits not in _costs:
        ways = splits(bits)
        cost = np.zeros((len(ways), bits + 1))
        for i, way in enumerate(ways):
            done = 0
            for j, w in enumerate(way):
                cost[i, done] += w + (j < len(way) - 1)  # ids above ``done`` bits (all, at first) pay this level
                done += w
        _costs[bits] = ways, cost
    ways, cost = _costs[bits]
    reach = np.array([len(ids), *[int((ids >> d > 0).sum()) for d in range(1, bits)], 0])
    return ways[int(np.argmin(cost @ reach))]


def encode(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint32)
    way = widths(ids)
    out = [struct.pack(f"<IB{len(way)}B", len(ids), len(way), *way)]
    for j, w in enumerate(way):
        chunk = ids & np.uint32((1 << w) - 1)
        bits = ((chunk[:, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        out += [struct.pack("<I", len(ids)), np.packbits(bits.ravel(), bitorder="little").tobytes()]
        if j < len(way) - 1:
            more = (ids >> np.uint32(w)) > 0
            before = np.r_[0, np.cumsum(more)][: max(1, len(more)) : BLOCK]
            out += [np.packbits(more, bitorder="little").tobytes(), before.astype("<u4").tobytes()]
            ids = ids[more] >> np.uint32(w)
    return b"".join(out)


def _levels(code: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """Width and count of each level, and where its chunks, its bitmap and its directory begin."""
    n = code[4]
    at = 5 + n
    for j in range(n):
        w, count = code[5 + j], int.from_bytes(code[at : at + 4], "little")
        chunks = at + 4
        bitmap = chunks + (count * w + 7) // 8
        directory = bitmap + (count + 7) // 8
        at = directory + 4 * max(1, -(-count // BLOCK))
        yield w, count, chunks, bitmap, directory


def token_at(code: bytes, i: int) -> int:
    """The id at place ``i``, by direct access."""
    if not 0 <= i < int.from_bytes(code[:4], "little"):
        raise IndexError(i)
    value, shift, last = 0, 0, code[4] - 1
    for j, (w, _, chunks, bitmap, directory) in enumerate(_levels(code)):
        bit = i * w
        word = int.from_bytes(code[chunks + bit // 8 : chunks + (bit + w + 7) // 8], "little")
        value |= (word >> bit % 8 & (1 << w) - 1) << shift
        shift += w
        if j == last or not code[bitmap + i // 8] >> i % 8 & 1:
            return value
        block = i // BLOCK
        rank = int.from_bytes(code[directory + 4 * block : directory + 4 * block + 4], "little")
        inner = int.from_bytes(code[bitmap + block * BLOCK // 8 : bitmap + i // 8 + 1], "little") & (1 << (i - block * BLOCK)) - 1
        i = rank + inner.bit_count()
    return value


def decode(code: bytes) -> np.ndarray:
    """All ids."""
    levels = list(_levels(code))
    out = np.zeros(0, np.uint32)
    for j in reversed(range(len(levels))):
        w, count, chunks, bitmap, _ = levels[j]
        bits = np.unpackbits(np.frombuffer(code, np.uint8, (count * w + 7) // 8, chunks), count=count * w, bitorder="little").reshape(count, w)
        value = (bits.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        if j < len(levels) - 1:
            more = np.unpackbits(np.frombuffer(code, np.uint8, (count + 7) // 8, bitmap), count=count, bitorder="little").astype(bool)
            value[more] |= out << np.uint32(w)
        out = value
    return out


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, code) for every row; ``vocabulary`` is read on the driver and sent along."""
    held = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value, pattern)
        for batch, texts in tx.batches(source, 1):
            ids = [None if t is None else np.array(enc.encode_ordinary(t), np.uint32) for t in texts]
            codes = [None if x is None else encode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else len(x) for x in ids], pa.int32()), pa.array(codes, pa.binary())], ["doc_id", "tokens", "code"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, tokens int, code binary")
