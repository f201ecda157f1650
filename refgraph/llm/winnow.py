"""Operator 2: document fingerprints by winnowing.

The hashes of all runs of ``K`` successive normalised words roll over the text; of every ``WINDOW`` successive ones the
least is chosen, of equal ones the rightmost. Each chosen hash is kept once with its position (the number of its first
word), so any two texts that share ``WINDOW + K - 1`` successive words share a fingerprint that lies inside the shared
stretch at known places in both. One pass over the scan; nothing is shuffled.

Defined cases: a null or empty text, or one of fewer than ``K`` words, has no fingerprints (empty lists); one of fewer than
``WINDOW`` runs has a single window; a very long one is read whole. Ids may be null or repeat: every row gives a row. Other columns are never read, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refgraph.llm import text as tx

K = 5
WINDOW = 8


def chosen(h: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all texts: hash, place in the joint word array, and text of each, in order of place.

    ``h`` are word hashes, those of text i from ``first[i]`` to ``first[i + 1]``.
    """
    g = tx.kgrams(h, k)
    n = len(g)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok, owner = tx.inside(first, k, n)
    last = first[owner + 1] - k  # last run of the same text
    at, best = np.arange(n), g.copy()
    for j in range(1, window):
        there = np.minimum(np.arange(n) + j, last)
        other = g[np.maximum(there, 0)]
        less = (other <= best) & (there == np.arange(n) + j)
        at, best = np.where(less, there, at), np.where(less, other, best)
    full = np.arange(n) + window - 1 <= last
    short = (np.arange(n) == first[owner]) & ok  # a text's first window counts even if it is short
    picked = np.unique(at[(full & ok) | short])
    return g[picked], picked, owner[picked]


def _fingerprint(k: int, window: int):
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.batches(source, 1):
            h, first = tx.hashed(texts)
            g, place, owner = chosen(h, first, k, window)
            sizes = np.bincount(owner, minlength=len(texts))
            places = pa.array((place - first[owner]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), tx.lists(tx.longs(g), sizes), tx.lists(places, sizes)], ["doc_id", "hashes", "positions"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions): the chosen hashes of each row in order of position."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_fingerprint(k, window), f"doc_id {kind}, hashes array<long>, positions array<int>")


SQL = f"""
with d as (select doc_id, row_number() over () as r, {tx.sql_words("coalesce(text, '')")} as w from documents),
hw as (select w, {tx.sql_word_hash("w")} as h from (select distinct unnest(w) as w from d)),
mw as (select w, {tx.sql_mixed("h")} as m from hw),
x as (select r, unnest(range(len(w))) as p, unnest(w) as w from d),
m as (select r, p, m from x join mw using (w)),
k as (select r, p, {", ".join(f"lead(m, {j}) over (partition by r order by p) as m{j}" for j in range(1, K))}, m as m0 from m),
g0 as (select r, p, {tx.sql_kgram([f"m{j}" for j in range(K)])} as h from k where m{K - 1} is not null),
g as (select r, p, {tx.sql_mixed("h")} as h from g0),
v as (
  select r, p, count(*) over ahead as n, arg_min(p, (h, -p)) over ahead as place
  from g window ahead as (partition by r order by p rows between current row and {WINDOW - 1} following)),
f as (select distinct r, place from v where n = {WINDOW} or p = 0),
o as (select f.r, list(case when h >= 9223372036854775808 then (h::HUGEINT - 18446744073709551616)::BIGINT else h::BIGINT end order by place) as hashes, list(place::INT order by place) as positions from f join g on g.r = f.r and g.p = f.place group by f.r)
select doc_id, coalesce(hashes, []) as hashes, coalesce(positions, []) as positions from d left join o using (r)
"""
