"""Operator 3: substring deduplication by seed and extend.

Texts are word sequences. A passage is repeated if all its stretches of ``LENGTH`` words occur at least twice in the corpus;
the result holds the maximal repeated passages of every document, as ranges of words.

Seeds: winnowing with runs of ``K`` words and windows of ``LENGTH - K + 1`` runs, so each stretch of ``LENGTH`` words holds an
anchor, at the same place wherever the stretch occurs. Documents meet on equal anchors. Extension: an anchor is extended both
ways as far as a stretch that holds it can reach. Partners aren't compared one by one, which would be quadratic in the copies
of a passage: anchors with equal extension (a hash) repeat each other wholly, however many there are; where the extensions
around one anchor differ, one of each kind yields the hashes of its stretches, and those that are found twice are repeated.
That finds exactly what comparing all pairs would. What is found is merged into maximal ranges: a range goes on as long as the
stretch that begins one word later is repeated too, so ranges may overlap or touch where the stretches between are not. No
partner cap is needed.

Anchors, one word in some twenty, are what is shuffled first; texts move only to join the open anchors of their document.

Defined cases: a null or empty text, or one of fewer than ``LENGTH`` words, has no repeats. Passages repeated inside one
document count. Wholly repeated rows (id and text) repeat each other and are reported once. A very long text is read whole. Ties don't arise. A null id is a value like others.
Other columns are never read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refgraph.llm import text as tx
from refgraph.llm import winnow
from refgraph.llm.shared import ready, rewritten

LENGTH = 50
K = 8


def _anchors(length: int, k: int):
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.batches(source, 2):
            h, first = tx.hashed(texts)
            g, place, owner = winnow.chosen(h, first, k, length - k + 1)
            long = np.diff(first)[owner] >= length
            g, place, owner = g[long], place[long], owner[long]
            left = np.maximum(first[owner], place - (length - k))
            right = np.minimum(first[owner + 1], place + length)
            shape = (place - left) * 1000003 + (right - place)
            around = tx.mixed(tx.span_hashes(tx.mixed(h), left, right) + shape.astype(np.uint64) * np.uint64(tx.MIX)) if len(g) else g
            rows = [batch.column(i).take(pa.array(owner)) for i in (0, 1)]  # never the texts
            place, room = pa.array((place - first[owner]).astype(np.int32)), pa.array((right - place).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*rows, tx.longs(g), tx.longs(around), place, room], ["id", "th", "g", "around", "place", "room"])

    return run


def _stretches(length: int, k: int):
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.batches(source, 2):
            h, first = tx.hashed(texts)
            lists = batch.column(3)
            at = np.asarray(lists.flatten())
            owner = np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
            n = np.diff(first)[owner]
            low, high = np.maximum(0, at - (length - k)), np.minimum(at, n - length)
            count = high - low + 1
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.unique(np.repeat(first[owner] + low, count) + step)
            whose = np.searchsorted(first, start, "right") - 1
            hashes = tx.mixed(tx.span_hashes(tx.mixed(h), start, start + length)) if len(start) else np.zeros(0, np.uint64)
            rows = [batch.column(i).take(pa.array(whose)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rows, tx.longs(hashes), pa.array((start - first[whose]).astype(np.int32))], ["id", "th", "h", "left"])

    return run


def _merge(length: int):
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            left, right = (np.asarray(lists.flatten().field(i)).astype(np.int64) for i in (0, 1))
            if not len(left):
                continue
            order = np.lexsort((left, owner))
            owner, left, right = owner[order], left[order], right[order]
            reach = np.maximum.accumulate(right + owner * (1 << 40))  # never reaches into the next document
            fresh = np.r_[True, (owner[1:] << 40) + left[1:] > reach[:-1] - length + 1]  # beyond the start after the last repeated one
            begin = np.flatnonzero(fresh)
            end = reach[np.r_[begin[1:] - 1, len(reach) - 1]] - owner[begin] * (1 << 40)
            rows = batch.column(0).take(pa.array(owner[begin]))
            yield pa.RecordBatch.from_arrays([rows, pa.array(left[begin].astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "start", "end"])

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, start, end): maximal repeated ranges of words, from 0, end exclusive."""
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    key = f"id struct<id: {kind}>, th long"
    source = docs.select(F.struct(F.col(id_col).alias("id")).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    # Most anchors occur once: counts of the hashes alone decide that, and only the others move with all they carry.
    seeds = rewritten(source.mapInArrow(_anchors(length, k), f"{key}, g long, around long, place int, room int"))
    again = seeds.groupBy("g").agg(F.count(F.lit(1)).alias("all")).where("all > 1").select("g")
    shared = rewritten(seeds.join(again, "g", "left_semi"))
    alike = shared.groupBy("g", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "place")).alias("one"))
    kinds = alike.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("g")
    whole = shared.join(alike.where("n > 1").select("g", "around"), ["g", "around"], "left_semi")
    whole = whole.select("id", "th", F.greatest(F.col("place") - (length - k), F.lit(0)).alias("left"), (F.col("place") + F.col("room")).alias("right"))
    opened = alike.join(kinds, "g", "left_semi").select("one.*").groupBy("id", "th").agg(F.collect_set("place").alias("places"))
    stretches = rewritten(source.join(opened, ["id", "th"]).mapInArrow(_stretches(length, k), f"{key}, h long, left int"))
    twice = stretches.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    part = stretches.join(twice, "h", "left_semi").select("id", "th", "left", (F.col("left") + length).alias("right"))
    ranges = whole.unionByName(part).groupBy("id", "th").agg(F.collect_set(F.struct("left", "right")).alias("ranges"))
    return ranges.select("id.id", "ranges").mapInArrow(_merge(length), f"doc_id {kind}, start int, end int")


SQL = f"""
with d as (select doc_id, text, row_number() over () as r, {tx.sql_words("text")} as w from documents where text is not null),
s as (select doc_id, text, p, hash(w[p + 1 : p + {LENGTH}]) as h from (select doc_id, text, w, unnest(range(len(w) - {LENGTH - 1})) as p from d where len(w) >= {LENGTH})),
t as (select distinct doc_id, text, p from (select *, count(*) over (partition by h) as n from s) where n > 1),
e as (select *, case when p = lag(p) over (partition by doc_id, text order by p) + 1 then 0 else 1 end as fresh from t),
i as (select *, sum(fresh) over (partition by doc_id, text order by p) as island from e)
select doc_id, min(p)::INT as start, (max(p) + {LENGTH})::INT as "end" from i group by doc_id, text, island
"""
