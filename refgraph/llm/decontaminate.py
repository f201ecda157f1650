"""Operator 10: benchmark decontamination by a prefix-filtered set join.

Items and documents become sets of word shingles (``K`` successive normalised words). A document is contaminated by an item
if some window of it, as many shingles long as the item, holds at least ``ceil(threshold * s)`` of the item's ``s``
distinct shingles. Then it must hold one of the item's ``s - needed + 1`` rarest, its prefix; rarity is counted over all
documents. The documents' shingles meet the prefixes (a bitmap, then a sorted lookup). Length bound: the document has
``needed`` shingles at least. Positional bound: only the windows that touch a prefix hit are looked at, and none where the
stretch around the hits holds too few distinct shingles. The rest is verified exactly.

The benchmark side is broadcast in parts of ``PART_CHARS`` characters at most (one larger item makes a part by itself); a
larger benchmark takes more parts and passes, with the same result. Documents are never shuffled.

Defined cases: null or empty texts have no shingles and neither contaminate nor are contaminated; nor does an item of fewer
than ``K`` words. A very long text is searched whole; ids of any type that Arrow knows will do. Ties in rarity go by hash. Repeated rows of either table each give their rows. The reported window is the
first with the most shingles. Other columns are never read by ``hits`` and pass through ``clean``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from refgraph.llm import text as tx

K = 3
THRESHOLD = 0.6
PART_CHARS = 16_000_000
BITS = 22


class Index(NamedTuple):
    """One part of the benchmark: sorted prefix shingles, and the items that each belongs to."""

    ids: list
    keys: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    sets: list[np.ndarray]
    length: np.ndarray
    needed: np.ndarray
    bitmap: np.ndarray


def _bitmap(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << BITS, bool)
    seen[keys >> np.uint64(64 - BITS)] = True
    return seen


def _lookup(h: np.ndarray, keys: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``h`` of members of the sorted ``keys``, and which."""
    at = np.flatnonzero(bitmap[h >> np.uint64(64 - BITS)])
    if not len(keys) or not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    same = keys[which] == h[at]
    return at[same], which[same]


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts that have some, and the text of each."""
    h, first = tx.hashed(texts)
    g = tx.kgrams(h, k)
    ok, owner = tx.inside(first, k, len(g))
    return g[ok], owner[ok]


def _counter(keys: np.ndarray, k: int) -> Callable:
    def count(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, total = _bitmap(keys), np.zeros(len(keys), np.int64)
        for _, texts in tx.batches(source, 0):
            np.add.at(total, _lookup(shingles(texts, k)[0], keys, bitmap)[1], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    return count


def index(docs: DataFrame, items: list[tuple], text_col: str, k: int, threshold: float) -> Index:
    """The search structure of one part of the benchmark; counts its shingles over all documents."""
    g, owner = shingles([t for _, t in items], k)
    bounds = np.searchsorted(owner, np.arange(len(items) + 1))
    every = np.unique(g)
    frequency = np.zeros(len(every), np.int64)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_counter(every, k), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    frequency[np.asarray(rows["key"])] = np.asarray(rows["n"])
    sets, needed, keys, whose = [], np.zeros(len(items), np.int64), [], []
    for i in range(len(items)):
        s = np.unique(g[bounds[i] : bounds[i + 1]])
        sets.append(s)
        needed[i] = math.ceil(threshold * len(s) - 1e-9)
        if len(s):
            rare = s[np.lexsort((s, frequency[np.searchsorted(every, s)]))][: len(s) - needed[i] + 1]
            keys.append(rare)
            whose.append(np.full(len(rare), i))
    keys, whose = (np.concatenate(keys), np.concatenate(whose)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(keys, kind="stable")
    distinct, starts = np.unique(keys[order], return_index=True)
    return Index([i for i, _ in items], distinct, np.r_[starts, len(keys)], whose[order], sets, np.diff(bounds), needed, _bitmap(distinct))


def best_window(where: np.ndarray, which: np.ndarray, length: int) -> tuple[int, int]:
    """Most distinct shingles in ``length`` successive places, and the first hit of the first such window."""
    count: dict[int, int] = {}
    best, start, low = 0, -1, 0
    for high, sid in enumerate(which):
        while where[low] <= where[high] - length:
            count[which[low]] -= 1
            if not count[which[low]]:
                del count[which[low]]
            low += 1
        count[sid] = count.get(sid, 0) + 1
        if len(count) > best:
            best, start = len(count), where[low]
    return best, start


def find(texts: list[str | None], ix: Index, k: int) -> list[tuple[int, int, int, int]]:
    """(text, item, start, shingles found) for every contamination, in order."""
    g, owner = shingles(texts, k)
    at, key = _lookup(g, ix.keys, ix.bitmap)
    if not len(at):
        return []
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = ix.starts[key + 1] - ix.starts[key]
    item = ix.items[np.repeat(ix.starts[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    at = np.repeat(at, n)
    order = np.lexsort((at, item, owner[at]))
    at, item, doc = at[order], item[order], owner[at[order]]
    out = []
    cuts = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0), True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        d, i = int(doc[a]), int(item[a])
        low, high, length, needed = int(first[d]), int(first[d + 1]), int(ix.length[i]), int(ix.needed[i])
        if high - low < needed:
            continue
        hits, best, start = at[a:b], 0, -1
        ends = np.flatnonzero(np.r_[np.diff(hits) >= 2 * length, True]) + 1  # stretches of hits whose windows could overlap
        begin = 0
        for end in ends.tolist():
            left, right = max(low, int(hits[begin]) - length + 1), min(high, int(hits[end - 1]) + length)
            begin = end
            s, part = ix.sets[i], g[left:right]
            which = np.minimum(np.searchsorted(s, part), len(s) - 1)
            where = np.flatnonzero(s[which] == part)
            if len(np.unique(which[where])) < needed:
                continue
            found, place = best_window(where.tolist(), which[where].tolist(), length)
            if found > best:
                best, start = found, left + place - low
        if best >= needed:
            out.append((d, i, start, best))
    return out


def parts(bench: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in lists of bounded size; each is collected by itself."""
    b = bench.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    chars = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * chars / PART_CHARS))
    for i in range(n):
        rows = b.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).orderBy("id", "text").toArrow().to_pydict()
        yield list(zip(rows["id"], rows["text"]))


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, found, total) for each contaminated document and item; start counts the document's words."""
    kinds = docs.schema[id_col].dataType.simpleString(), bench.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start int, found int, total int"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out, item_type = None, to_arrow_type(bench.schema[item_col].dataType)
    for items in parts(bench, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index(docs, items, text_col, k, threshold))

        def search(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ix = held.value
            for batch, texts in tx.batches(batches, 1):
                found = find(texts, ix, k)
                rows, which = [x[0] for x in found], [x[1] for x in found]
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([ix.ids[i] for i in which], item_type), *(pa.array(x, pa.int32()) for x in ([x[2] for x in found], [x[3] for x in found], [len(ix.sets[i]) for i in which]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "found", "total"])

        part = source.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that no item contaminates, all their columns."""
    every = docs  # rarity is counted over all documents for each part, those that an earlier part took included
    for items in parts(bench, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index(every, items, text_col, k, threshold))
        at = docs.columns.index(text_col)

        def keep(batches: Iterable[pa.RecordBatch], held=held, at=at) -> Iterator[pa.RecordBatch]:
            for batch, texts in tx.batches(batches, at):
                stays = np.ones(len(texts), bool)
                stays[[x[0] for x in find(texts, held.value, k)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


SQL = f"""
with d as (select doc_id, {tx.sql_words("text")} as w from documents where text is not null),
ds as (select doc_id, p, [w[p], w[p + 1], w[p + 2]] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from d)),
b as (select item_id, {tx.sql_words("text")} as w from benchmark where text is not null),
bs as (select item_id, len(w) - 2 as n, [w[p], w[p + 1], w[p + 2]] as s from (select item_id, w, unnest(range(1, len(w) - 1)) as p from b)),
items as (select item_id, any_value(n) as n, count(distinct s) as total from bs group by item_id),
m as (select ds.doc_id, x.item_id, ds.p, ds.s from ds join (select distinct item_id, s from bs) x on x.s = ds.s),
win as (
  select a.doc_id, a.item_id, a.p, count(distinct b.s) as found
  from m a join items i using (item_id) join m b on b.doc_id = a.doc_id and b.item_id = a.item_id and b.p >= a.p and b.p < a.p + i.n
  group by all)
select doc_id, item_id, (arg_max(p, (found, -p)) - 1)::INT as start, max(found)::INT as found, any_value(total)::INT as total
from win join items using (item_id) group by doc_id, item_id
having max(found) >= ceil({THRESHOLD} * any_value(total) - 1e-9)
"""
