"""Operator 4: line deduplication over overlapping windows of three lines.

The text is cut at line feeds. Every three consecutive lines form a window, known by a 96-bit hash. A window that occurs
more than once anywhere keeps its first occurrence; the lines that a later one covers are removed, covered positions of
overlapping windows being merged. Where a later occurrence overlaps the first one itself (the same line four times in a row), the
lines of the first stay. Occurrences are ordered by document id (null last), hash of the text and position, so
windows that repeat inside one document count too. Occurrences are decided on the original texts, all at once.

The first occurrences come from a partially aggregated minimum and meet the windows in an equi-join that adaptive execution
can split, so a window with millions of occurrences doesn't end in one task. Only ids, hashes and positions are shuffled
for that; then each text moves once, to its removals.

Defined cases: a null text stays null and a text of under three lines is left alone; blank lines count as lines, but a
window of three blank ones is no window. Rows with equal id and text are one document and get the same result. A document
can lose all its lines; its text is then empty. Of documents with equal id and different texts the lesser hash comes first. A text
of any length is cut whole, into as many windows as it has. Other columns pass through, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refgraph.llm.shared import ready

WINDOW = 3


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, p, a, b): document key, position and hash of every window of lines."""
    lines = F.split(F.col(text_col), "\n")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.length(F.trim(x)) > 0).alias("full")))
    one = docs.select(F.struct(F.col(id_col).alias("id")).alias("id"), F.xxhash64(text_col).alias("th"), hashed.alias("h")).where(F.size("h") >= WINDOW)
    shifted = [F.slice("h", 1 + i, F.size("h") - (WINDOW - 1)).alias(f"l{i}") for i in range(WINDOW)]
    row = one.select("id", "th", F.posexplode(F.arrays_zip(*shifted)).alias("p", "w"))
    parts = [F.col(f"w.l{i}.{x}") for i in range(WINDOW) for x in "ab"]
    full = F.expr(" or ".join(f"w.l{i}.full" for i in range(WINDOW)))
    return row.where(full).select("id", "th", "p", F.xxhash64(*parts).alias("a"), F.hash(*parts[::-1]).alias("b"))


def later(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, gone): for each document key its windows that occurred before, as ``WINDOW`` times the position plus the number of
    lines that belong to the first occurrence (those of a window that overlaps itself)."""
    ready(docs.sparkSession)
    every = windows(docs, id_col, text_col).checkpoint()
    place = F.struct(F.col("id.id").isNull().alias("none"), "id", "th", "p")
    first = every.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first")
    again = every.join(first, ["a", "b"]).where(place != F.col("first"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    spared = F.when(same, F.greatest(F.col("first.p") + WINDOW - F.col("p"), F.lit(0))).otherwise(0)
    return again.groupBy("id", "th").agg(F.collect_set(F.col("p").cast("long") * WINDOW + spared).alias("gone"))


def _cut(text: str, gone: np.ndarray) -> tuple[str, int]:
    lines = text.split("\n")
    keep = np.ones(len(lines), bool)
    at, spared = np.divmod(gone, WINDOW)
    for i in range(WINDOW):
        keep[at[spared <= i] + i] = False
    return "\n".join(x for x, k in zip(lines, keep.tolist()) if k), int((~keep).sum())


def _rewrite(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        row, text, gone = batch.columns
        hit = np.flatnonzero(np.asarray(gone.is_valid()))
        removed = np.zeros(batch.num_rows, np.int32)
        if len(hit):
            cut = [_cut(text[i].as_py(), np.asarray(gone[i].values)) for i in hit.tolist()]
            removed[hit] = [n for _, n in cut]
            pieces, at = [], 0
            for i, (new, _) in zip(hit.tolist(), cut):
                pieces += [text.slice(at, i - at), pa.array([new], text.type)]
                at = i + 1
            text = pa.concat_arrays([*pieces, text.slice(at)])
        yield pa.RecordBatch.from_arrays([row, text, pa.array(removed)], ["row", "text", "removed"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, removed): each row with its other columns as a struct, its remaining text and how many lines went."""
    found = later(docs, id_col, text_col)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    keyed = docs.select(F.struct(F.col(id_col).alias("id")).alias("id"), F.xxhash64(text_col).alias("th"), F.struct(*rest).alias("row"), F.col(text_col).alias("text"))
    joined = keyed.join(found, ["id", "th"], "left").select("row", "text", "gone")
    out = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())])
    return joined.mapInArrow(_rewrite, out)


SQL = r"""
with lines as (
  select doc_id, text, row_number() over () as r, string_split(text, chr(10)) as l from documents where text is not null),
w as (
  select doc_id, text, p, l[p + 1] as a, l[p + 2] as b, l[p + 3] as c
  from (select doc_id, text, l, unnest(range(len(l) - 2)) as p from lines where len(l) >= 3)
  where trim(l[p + 1], ' ') <> '' or trim(l[p + 2], ' ') <> '' or trim(l[p + 3], ' ') <> ''),
ranked as (select doc_id, text, p, rank() over same as k, first_value(doc_id) over same as d1, first_value(text) over same as t1, first_value(p) over same as p1
  from w window same as (partition by a, b, c order by doc_id nulls last, p)),
gone as (select distinct doc_id, text, p + d as i from ranked, range(3) t(d) where k > 1 and not (d1 = doc_id and t1 = text and p + d < p1 + 3)),
cut as (
  select x.doc_id, x.r, x.i, x.line, g.i is not null as away
  from (select doc_id, text, r, unnest(range(len(l))) as i, unnest(l) as line from lines) x
  left join gone g on g.doc_id = x.doc_id and g.text = x.text and g.i = x.i)
select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (not away), '') as text, count(*) filter (away)::INT as removed
from cut group by doc_id, r
"""
