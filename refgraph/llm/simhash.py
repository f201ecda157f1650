"""Operator 1: SimHash near-duplicates, all of them.

Every document gets a 128-bit SimHash of its set of word bigrams (a one-word document: of that word). Two documents are near
duplicates if their fingerprints differ in at most ``radius`` bits, whatever else they have in common. The search over distinct
fingerprints is exact. A fingerprint is cut into two halves and ``PARTS`` parts of 16 bits. If two differ in at most ``radius``
bits, then some half differs in no more bits than ``limits`` says of it, and some part of that half in no more than ``reaches``
says (else the halves, or its parts, would add up to more). So part by part each value of the part is looked up with all values
that close, the fingerprints under them are compared by that part's half, and the few whose half is near are compared whole. For
radius 28 halves are compared for 6 % of all pairs, and every pair within the radius is among them. Up to ``SMALL`` fingerprints
are compared each with each.

Fingerprints are cut into blocks by a hash; a task has two blocks (or one with itself) and one part, so what a task holds is
bounded, whatever the texts are like, and nothing is broadcast. They travel as packed bytes. The more blocks, the more tasks
each fingerprint goes to: ``PARTS`` for each block. A task gives a spanning star of what it linked, not its pairs, and doesn't
compare what it has linked already, so that many copies of one text don't cost their square.

The search before, BK-trees of shards that are named by minhash bands (``links``), finds only pairs that meet in a shard; no
query uses it any more. One tree over everything would be exact, but at radius 28 of 128 bits it could hardly leave out anything,
as most distances are near 64.

Groups are the connected components of near-duplicate fingerprints (large star, small star, with a checkpoint a round).

Defined cases: a null or empty text, or one without letters or digits, has no fingerprint and is never a duplicate. Equal
documents share a fingerprint and so a group. Of a group the row with the least id stays, a null id counting as the greatest;
ties are broken by the hash of the text, and of wholly repeated rows one stays. A very long text is read whole. Other columns are never read, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refgraph.llm import text as tx
from refgraph.llm.shared import components, ready

RADIUS = 28
BANDS = 8
BAND_WIDTH = 2
#: Second half of the fingerprint: bigram hashes mixed once more after xor with this.
HALF = 0xD6E8FEB86659FD93
SEEDS = [pow(tx.BASE, 3 + 2 * i, tx.TWO64) | 1 for i in range(BANDS * BAND_WIDTH)]
#: (query, node) pairs that a search holds at once.
FRONTIER = 2_000_000
#: Parts of 16 bits of a fingerprint.
PARTS = 8
#: Fingerprints of a shard that make one tree.
BLOCK = 6_000
#: Fingerprints of a block of the exact search by parts, and of one where each is compared with each.
CELL, CELL_SMALL = 1_000_000, 10_000
#: Up to so many fingerprints are compared each with each.
SMALL = 30_000
#: Tasks at least, where they are searched by parts, and at most.
TASKS, MOST_TASKS = 32, 5_000
#: Pairs taken up at once, those of them compared in one go (what fits a core's cache), and pairs found that are kept before they are joined.
PAIRS, CACHED, FOUND = 200_000, 64_000, 500_000

#: spread[b] has bit i of the byte b in the i-th of eight bytes, highest bit first.
_SPREAD = np.array([sum((b >> i & 1) << 8 * (7 - i) for i in range(8)) for b in range(256)], np.uint64)
#: All values of a part, those with fewer bits first.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << 16)), kind="stable")


def bigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts, each once a text, and the text of each."""
    h, first = tx.hashed(texts)
    two = tx.kgrams(h, 2)
    ok, owner = tx.inside(first, 2, len(two))
    alone = np.flatnonzero(np.diff(first) == 1)
    features, owners = np.r_[two[ok], tx.mixed(h[first[alone]])], np.r_[owner[ok], alone]
    order = np.lexsort((features, owners))
    features, owners = features[order], owners[order]
    once = np.r_[True, (features[1:] != features[:-1]) | (owners[1:] != owners[:-1])] if len(features) else np.zeros(0, bool)
    return features[once], owners[once]


def _votes(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each group of features and each of the 64 bits, how many features have it."""
    within = np.arange(len(features)) - np.repeat(starts, np.diff(np.r_[starts, len(features)]))
    chunks = np.flatnonzero(within % 255 == 0)  # 255 features can't overflow a byte
    lanes = np.add.reduceat(_SPREAD[features.view(np.uint8).reshape(-1, 8)], chunks, axis=0)
    return np.add.reduceat(lanes.view(np.uint8).reshape(len(chunks), 64).astype(np.int64), np.searchsorted(chunks, starts), axis=0)


def signatures(texts: list[str | None], banded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts have a fingerprint, those fingerprints (two unsigned longs each), and their band keys (zeros unless ``banded``)."""
    features, owner = bigrams(texts)
    if not len(features):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros((0, BANDS), np.uint64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.r_[starts, len(features)])
    halves = []
    for f in (features, tx.mixed(features ^ np.uint64(HALF))):
        bits = np.packbits(2 * _votes(f, starts) > sizes[:, None], axis=1)
        halves.append(np.ascontiguousarray(bits).view(np.uint64).ravel())
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for i, seed in enumerate(SEEDS if banded else []):
        least = np.minimum.reduceat(features * np.uint64(seed), starts)
        keys[:, i // BAND_WIDTH] = keys[:, i // BAND_WIDTH] * np.uint64(tx.BASE) + tx.mixed(least)
    return owner[starts], np.stack(halves, axis=1), tx.mixed(keys + np.arange(BANDS, dtype=np.uint64))


def _sign(banded: bool):
    def sign(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.batches(source, 2):
            have, fp, keys = signatures(texts, banded)
            rows = batch.take(pa.array(have))
            columns = {"id": rows.column(0), "th": rows.column(1), "hi": tx.longs(np.ascontiguousarray(fp[:, 0])), "lo": tx.longs(np.ascontiguousarray(fp[:, 1]))}
            if banded:
                columns["bands"] = tx.lists(tx.longs(keys.ravel()), np.full(len(have), BANDS))
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return sign


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", banded: bool = True) -> DataFrame:
    """(id, th, hi, lo, bands if ``banded``) for every document that has a word; th is a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return source.mapInArrow(_sign(banded), f"id {kind}, th long, hi long, lo long" + ", bands array<long>" * banded)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def bk_build(fp: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1: a root) and distance to it, for distinct fingerprints grouped by shard; the first of a shard is its root."""
    n = len(fp)
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    left, group = np.arange(n), shard.astype(np.int64)
    while len(left):
        head = np.r_[True, group[1:] != group[:-1]]
        node = np.repeat(left[head], np.diff(np.r_[np.flatnonzero(head), len(left)]))
        left, node = left[~head], node[~head]  # what isn't a node of this level goes below one
        d = hamming(fp[left], fp[node])
        parent[left], edge[left] = node, d
        order = np.lexsort((left, d, node))
        left, group = left[order], node[order] * 129 + d[order]
    return parent, edge


def bk_search(fp: np.ndarray, parent: np.ndarray, edge: np.ndarray, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within ``radius``, each query searching the tree under its root; pairs of a node with itself too."""
    order = np.lexsort((edge, parent))
    key = parent[order] * 129 + edge[order]  # children of a node lie together, by edge
    stack = [(queries, roots)]
    while stack:
        q, node = stack.pop()
        if len(q) > FRONTIER:
            stack += [(q[i : i + FRONTIER], node[i : i + FRONTIER]) for i in range(0, len(q), FRONTIER)]
            continue
        d = hamming(fp[q], fp[node])
        hit = d <= radius
        if hit.any():
            yield q[hit], node[hit]
        low = np.searchsorted(key, node * 129 + np.maximum(d - radius, 0))
        count = np.searchsorted(key, node * 129 + np.minimum(d + radius, 128), "right") - low
        if total := int(count.sum()):
            step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            stack.append((np.repeat(q, count), order[np.repeat(low, count) + step]))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, the least node of each component, after the pairs (a, b) were joined."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def spanning(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of ``pairs`` over ``n`` nodes: every other node with the component's least."""
    label = np.arange(n)
    for a, b in pairs:
        label = merged(label, a, b)
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]


def _shares(radius: int, levels: int) -> list[int]:
    """The radius cut in two, ``levels`` times: were each share to be exceeded by one at least, they would add up to more than the radius."""
    shares = [radius + 1]
    for _ in range(levels):
        shares = [x for b in shares for x in (b - b // 2, b // 2)]
    return [b - 1 for b in shares]


def limits(radius: int) -> list[int]:
    """For each half a number of bits, such that two fingerprints within ``radius`` differ in no more in some half."""
    return _shares(radius, 1)


def reaches(radius: int) -> list[int]:
    """For each part a number of bits, such that two fingerprints that differ in no more than ``limits`` in a half differ in no more
    in some part of that half; -1: no need to look there."""
    return _shares(radius, PARTS.bit_length() - 1)


def linked(fp: np.ndarray, cell: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges whose components are those of all pairs within ``radius`` in the same cell; where some of a cell's rows ask, of the
    pairs of one that asks and one that doesn't. Rows are grouped by cell, those that don't ask first.

    In a cell of nodes alone, what lies within the radius of the root is one component already, so only the others ask the
    tree; they ask all of it.
    """
    node = np.flatnonzero(~asks)
    parent, edge = bk_build(fp[node], cell[node])
    head = np.flatnonzero(np.diff(cell[node], prepend=-1))  # of a cell's nodes the first
    which = np.searchsorted(cell[node][head], cell)
    root = head[np.minimum(which, len(head) - 1)]
    known = cell[node][root] == cell  # a cell may be without nodes
    two = np.zeros(len(fp), bool)
    two[np.isin(cell, np.unique(cell[asks]))] = True
    near = ~asks & ~two & (node[root] != np.arange(len(fp))) & (hamming(fp, fp[node][root]) <= radius)
    queries = np.flatnonzero(known & (asks | ~two & ~near & (node[root] != np.arange(len(fp)))))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.flatnonzero(near), node[root[near]]
        # The tree knows nodes by their number among nodes; queries are appended behind them.
        every = np.concatenate([fp[node], fp[queries]])
        for q, at in bk_search(every, parent, edge, len(node) + np.arange(len(queries)), root[queries], radius):
            yield queries[q - len(node)], node[at]

    return spanning(len(fp), pairs())


def _link(radius: int):
    def link(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            cells = batch.column(0)
            sizes = np.diff(np.asarray(cells.offsets))
            flat = cells.flatten()
            asks = np.asarray(flat.field(0).to_numpy(zero_copy_only=False), bool)
            fp = np.stack([np.asarray(flat.field(i)) for i in (1, 2)], axis=1).view(np.uint64)
            ends = np.cumsum(sizes)
            begin = 0
            for cut in [*np.flatnonzero(np.diff(ends // 200_000)), len(sizes) - 1]:  # cells aren't cut
                part = slice(ends[begin] - sizes[begin], ends[cut])
                a, b = linked(fp[part], np.repeat(np.arange(begin, cut + 1), sizes[begin : cut + 1]), asks[part], radius)
                x, y = fp[part][a].view(np.int64), fp[part][b].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([np.ascontiguousarray(z[:, i]) for i in (0, 1)], ["hi", "lo"]) for z in (x, y)], ["a", "b"])
                begin = cut + 1

    return link


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between fingerprints, enough to connect all near duplicates that meet in a shard, and no others: what the
    queries use is ``all_links``. Found cell by cell. A shard of up to ``block``
    fingerprints is one cell; of a larger one each two blocks are."""
    shards = prints.select(F.explode("bands").alias("band"), "hi", "lo").distinct()
    large = shards.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("band", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    cut = shards.join(large, "band", "left").withColumn("own", F.pmod(F.xxhash64("hi", "lo"), F.coalesce("blocks", F.lit(1))))
    met = cut.select("band", "hi", "lo", "own", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
    rows = F.struct((F.col("own") > F.col("other")).alias("asks"), "hi", "lo")
    cells = met.groupBy("band", F.least("own", "other"), F.greatest("own", "other")).agg(F.collect_list(rows).alias("rows"))
    cells = cells.where(F.size("rows") > 1).select(F.sort_array("rows").alias("rows"))
    kind = "struct<hi: long, lo: long>"
    return cells.mapInArrow(_link(radius), f"a {kind}, b {kind}").distinct()


def joined(fp: np.ndarray, low: int, radius: int, part: int | None = None, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Edges whose components are those of all pairs within ``radius`` of one of the first ``low`` fingerprints and one of the
    rest; if there is no rest, of all pairs among the first. With a part only those pairs that are within its reach there and,
    of ``turns``, have their turn.
    """
    n, label, found, held = len(fp), np.arange(len(fp)), [], 0
    key = np.zeros(n, np.int64) if part is None else np.ascontiguousarray(fp).view(np.uint16)[:, part].astype(np.int64)
    ball = _MASKS[: 1 if part is None else np.count_nonzero(np.bitwise_count(_MASKS) <= reaches(radius)[part])]
    ask = np.argsort(key[:low], kind="stable")
    node = ask if low == n else low + np.argsort(key[low:], kind="stable")
    half = None if part is None else 2 * part // PARTS
    sides = [(np.ascontiguousarray(fp[:, i]), fp[node, i]) for i in (0, 1) if half in (None, i)]
    limit = radius if part is None else limits(radius)[half]
    rest = fp if part is None else fp[:, [1 - half]]
    first = np.searchsorted(key[node], np.arange((1 << 16) + 1))
    heads = np.flatnonzero(np.diff(key[ask], prepend=-1))
    count = np.arange(n)
    for head, end in zip(heads, np.r_[heads[1:], low]):
        if (own := key[ask[head]]) % turns != turn:
            continue
        near = ball ^ own
        if low == n:
            near = near[near >= own]  # the others ask for this one
        begin = first[near]
        size = first[near + 1] - begin
        ends = np.cumsum(size)
        every = np.repeat(begin - ends + size, size) + count[: ends[-1]] if len(ends) else ends
        left = ask[head:end]
        while len(left) and len(every):
            some, at = left, every
            if len(left) * len(every) > PAIRS:
                mine = label[left] == label[left[0]]  # where there are many, those of one component needn't ask for that one
                if mine.sum() > 1:
                    some, at = left[mine], every[label[node[every]] != label[left[0]]]
                    if not len(at):
                        left = left[~mine]
                        continue
                some = some[: max(1, PAIRS // len(at))]
                left = left[~np.isin(left, some, assume_unique=True)]
            else:
                left = left[:0]
            theirs = [b[at] for _, b in sides]
            rows = max(1, CACHED // len(at))
            for i in range(0, len(some), rows):
                apart = [np.bitwise_count(a[some[i : i + rows], None] ^ b) for (a, _), b in zip(sides, theirs)]
                apart = apart[0] if len(apart) == 1 else apart[0] + apart[1]
                pair = np.flatnonzero(apart <= limit)
                q, to = some[i + pair // len(at)], node[at[pair % len(at)]]
                other = q != to
                if not other.any():
                    continue
                if part is not None:
                    other &= apart.ravel()[pair] + np.bitwise_count(rest[q] ^ rest[to])[:, 0] <= radius
                q, to = q[other], to[other]
                found.append((q, to))
                held += len(q)
            if held > FOUND:
                label, found, held = merged(label, *map(np.concatenate, zip(*found))), [], 0
    if found:
        label = merged(label, *map(np.concatenate, zip(*found)))
    end = np.flatnonzero(label != np.arange(n))
    return end, label[end]


def _pack(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints (own, hi, lo) as bytes, for every block of a batch."""
    for batch in source:
        own, fp = np.asarray(batch.column(0)), np.stack([np.asarray(batch.column(i)) for i in (1, 2)], axis=1)
        order = np.argsort(own, kind="stable")
        here, first = np.unique(own[order], return_index=True)
        packed = [x.tobytes() for x in np.split(fp[order], first[1:])] if len(here) else []
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(packed, pa.binary())], ["own", "packed"])


def _join(radius: int, by_part: bool, turns: int):
    def join(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x["cell"], x) for batch in source for x in batch.to_pylist())
        for _, cell in itertools.groupby(rows, lambda x: x[0]):
            sides: dict[int, list[bytes]] = {}
            for _, x in cell:
                sides.setdefault(x["own"], []).append(x["packed"])
                low, high, slot = x["low"], x["high"], x["slot"]
            sizes = {k: sum(map(len, v)) // 16 for k, v in sides.items()}
            if not (sizes.get(low) and sizes.get(high)):
                continue
            fp = np.frombuffer(b"".join(itertools.chain(*(sides[k] for k in dict.fromkeys((low, high))))), np.uint64).reshape(-1, 2)
            del sides
            a, b = joined(fp, sizes[low], radius, *((slot // turns, slot % turns, turns) if by_part else ()))
            for i in range(0, len(a), PAIRS):
                ends = [fp[z[i : i + PAIRS]].view(np.int64) for z in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([np.ascontiguousarray(z[:, i]) for i in (0, 1)], ["hi", "lo"]) for z in ends], ["a", "b"])

    return join


def all_links(prints: DataFrame, radius: int = RADIUS, block: int | None = None, small: int = SMALL) -> DataFrame:
    """Edges (a, b) between fingerprints (hi, lo), enough to connect all that are within ``radius``. Counts the fingerprints at once."""
    ready(prints.sparkSession)
    distinct = prints.select("hi", "lo").distinct().checkpoint()
    n = distinct.count()
    by_part = n > small
    blocks = max(1, -(-n // (block or (CELL if by_part else CELL_SMALL))))
    twos = blocks * (blocks + 1) // 2
    turns = max(1, -(-TASKS // (PARTS * twos))) if by_part else 1
    slots = [i for i in range(PARTS * turns if by_part else 1) if not by_part or reaches(radius)[i // turns] >= 0]
    packed = distinct.select(F.pmod(F.xxhash64("hi", "lo"), F.lit(blocks)).alias("own"), "hi", "lo").mapInArrow(_pack, "own long, packed binary")
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).withColumn("slot", F.explode(F.array(*map(F.lit, slots))))
    met = met.select("own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "slot", "packed")
    met = met.withColumn("cell", F.col("slot") * F.lit(twos) + F.expr("high * (high + 1) div 2") + F.col("low"))
    tasks = min(twos * PARTS * turns if by_part else twos, MOST_TASKS)
    cells = met.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell")
    kind = "struct<hi: long, lo: long>"
    return cells.mapInArrow(_join(radius, by_part, turns), f"a {kind}, b {kind}").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, th, n, kept_id, kept_th) for each document in a group of two rows at least; n counts equal rows.

    The row that stays is that of (kept_id, kept_th).
    """
    prints = fingerprints(docs, id_col, text_col, banded=False).groupBy("id", "th", "hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    ready(docs.sparkSession)
    prints = prints.checkpoint()
    label = components(all_links(prints, radius))
    fp = F.struct("hi", "lo")
    member = prints.select("id", "th", "n", fp.alias("node")).join(label, "node", "left").select("id", "th", "n", F.coalesce("component", "node").alias("component"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    kept = member.groupBy("component").agg(first.alias("kept"), F.sum("n").alias("size")).where("size > 1")
    return member.join(kept, "component").select("id", "th", "n", F.col("kept.id").alias("kept_id"), F.col("kept.th").alias("kept_th"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, kept_id): a row for each document that a near-duplicate group can spare, with the document that stays."""
    found = groups(docs, id_col, text_col, radius)
    stays = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th"))
    spare = found.withColumn("spare", F.col("n") - stays.cast("int")).where("spare > 0")
    return spare.select(F.explode(F.array_repeat(F.struct("id", "kept_id"), F.col("spare").cast("int"))).alias("x")).select(F.col("x.id").alias("doc_id"), F.col("x.kept_id").alias("kept_id"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents, all their columns, with one row left of each near-duplicate group."""
    stays = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th"))
    found = groups(docs, id_col, text_col, radius).select(F.struct("id").alias("id"), "th", stays.alias("stays"))
    keyed = docs.select(F.struct(F.col(id_col).alias("id")).alias("id"), F.xxhash64(text_col).alias("th"), F.struct("*").alias("row"))
    joined = keyed.join(found, ["id", "th"], "left").where("stays is null or stays")
    turn = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(0)))  # of repeated rows only one stays
    return joined.withColumn("turn", F.when(F.col("stays"), turn).otherwise(1)).where("turn = 1").select("row.*")
