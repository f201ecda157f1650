"""Operator 5: packing into length buckets of least padding, and token-budget batches inside each bucket.

A document's length is its number of tokens: runs of letters and digits, and every other character that is no blank or
control character. The lengths are counted over all documents; dynamic programming over that histogram chooses at most
``BUCKETS`` boundaries that minimise the total padding (each document is padded to its bucket's boundary), all in whole numbers.
The cost has the quadrangle inequality, so each layer is solved by divide and conquer, level by level in numpy. A batch holds as
many documents as keep ``documents * boundary`` within ``BUDGET`` tokens, and one at least. The histogram that the driver gets
has one row for each distinct length: with T tokens in all, fewer than the square root of 2 T.

Batches are filled in the order of a hash of id and length. No window spans a bucket: each bucket is divided into chunks by
ranges of that hash, the chunks' counts are summed into offsets, and rows are numbered inside their chunk only. Rows of equal id
and length are counted first and numbered together, so that they make one row until the end.

Defined cases: a null or empty text has length 0; documents of length 0 share batches of at most ``BUDGET`` rows in the first
bucket (or make it, with boundary 0). A document longer than the budget stays whole, alone in its batch. Rows with equal id each
take a place of their own; a null id is a value like others. Of equally good boundaries the lesser ones are taken. Other columns
are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refgraph.llm.shared import ready

BUCKETS = 16
BUDGET = 16_384
#: Rows of a bucket that are numbered in one task, about.
CHUNK_ROWS = 200_000
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x00-\x20\x7f]"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Greatest lengths of the buckets, ascending; ``lengths`` ascending and distinct."""
    n = len(lengths)
    if not n:
        return []
    c = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=c[1:])
    top = np.r_[0, lengths].astype(np.int64)
    best = np.r_[0, np.full(n, 1 << 62)]  # not reached yet
    choices = []
    for _ in range(min(buckets, n)):
        new, choice = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        a, b, low, high = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(a):  # all segments of a level at once: their middles, each over its candidates
            m = (a + b) // 2
            size = np.minimum(high, m - 1) - low + 1
            begin = np.cumsum(size) - size
            i = np.repeat(low - begin, size) + np.arange(size.sum())
            at = np.repeat(m, size)
            cost = np.where(best[i] < 1 << 62, best[i] + top[at] * (c[at] - c[i]), 1 << 62)
            least = np.minimum.reduceat(cost, begin)
            hit = np.flatnonzero(cost == np.repeat(least, size))
            k = i[hit[np.searchsorted(hit, begin)]]  # the first of equal ones
            new[m], choice[m] = least, k
            a, b, low, high = np.r_[a, m + 1], np.r_[m - 1, b], np.r_[low, k], np.r_[k, high]
            some = a <= b
            a, b, low, high = a[some], b[some], low[some], high[some]
        best = new
        choices.append(choice)
    out, j = [], n
    for choice in reversed(choices):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(choice[j])
    return out[::-1]


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, tokens, bucket, boundary, batch, place) for every row of ``docs``; place counts from 0 inside the batch."""
    ready(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN)), F.lit(0)).alias("tokens"))
    sized = sized.groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("copies")).checkpoint()
    seen = sized.groupBy("tokens").agg(F.sum("copies").alias("n")).orderBy("tokens").toArrow()
    lengths, counts = np.asarray(seen["tokens"]), np.asarray(seen["n"])
    edges = boundaries(lengths, counts, buckets)
    bucket = F.lit(len(edges) - 1)
    for i in reversed(range(len(edges) - 1)):
        bucket = F.when(F.col("tokens") <= edges[i], F.lit(i)).otherwise(bucket)
    chunks = max(1, int(counts.sum()) // chunk_rows)
    digest = F.md5(F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("tokens").cast("string")))
    placed = sized.withColumn("bucket", bucket).withColumn("boundary", F.element_at(F.array(*map(F.lit, edges or [0])), F.greatest("bucket", F.lit(0)) + 1)).withColumn("h", digest)
    # Ranges of the hash: its first 32 bits, cut into equal parts.
    placed = placed.withColumn("chunk", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(chunks) / F.lit(1 << 32)).cast("int"))
    chunk = placed.groupBy("bucket", "chunk").agg(F.sum("copies").alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunk.select("bucket", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "chunk").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("k", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, ["bucket", "chunk"])
    numbered = numbered.withColumn("first", F.col("before") + F.col("k")).withColumn("rank", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)))
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1)))).cast("long")
    return numbered.withColumn("per", per).select("doc_id", "tokens", "bucket", "boundary", F.concat_ws("-", "bucket", F.floor(F.col("rank") / F.col("per"))).alias("batch"), F.pmod("rank", "per").cast("int").alias("place"))


def _sql() -> str:
    """The same with the plain dynamic programme, each layer over all pairs of lengths."""
    layers = ["b1 as materialized (select m, (top * c)::HUGEINT as cost, 0 as choice from h where m > 0 union all select 0, 0, 0)"]
    for k in range(2, BUCKETS + 1):
        step = f"select x.m, b.cost + x.top * (x.c - y.c) as cost, y.m as i from h x join h y on y.m < x.m join b{k - 1} b on b.m = y.m"
        layers.append(f"b{k} as materialized (select m, min(cost) as cost, arg_min(i, (cost, i)) as choice from ({step}) group by m union all select 0, 0, 0)")
    ends = [f"j{BUCKETS} as materialized (select max(m) as j from h)", *(f"j{k - 1} as materialized (select choice as j from b{k} join j{k} on m = j)" for k in range(BUCKETS, 1, -1))]
    edges = " union ".join(f"select top from h join j{k} on m = j where m > 0" for k in range(1, BUCKETS + 1))
    token = TOKEN.replace("'", "''")
    return f"""
with sized as materialized (select doc_id, coalesce(len(regexp_extract_all(text, '{token}')), 0)::INT as tokens from documents),
h as materialized (select row_number() over (order by tokens) as m, tokens::HUGEINT as top, sum(n) over (order by tokens)::HUGEINT as c from (select tokens, count(*) as n from sized group by tokens) union all select 0, 0, 0),
{", ".join(layers)}, {", ".join(ends)},
edges as (select top::INT as boundary, (row_number() over (order by top) - 1)::INT as bucket from ({edges})),
placed as (select doc_id, tokens, min(boundary) as boundary, min(bucket) as bucket, any_value(r) as r from (select *, row_number() over () as r from sized) join edges on tokens <= boundary group by r, doc_id, tokens),
ranked as (select *, row_number() over (partition by bucket order by md5(coalesce(doc_id::VARCHAR, 'null') || '-' || tokens), doc_id, tokens) - 1 as rank, greatest(1, {BUDGET} // greatest(boundary, 1)) as per from placed)
select doc_id, tokens, bucket, boundary, bucket || '-' || (rank // per) as batch, (rank % per)::INT as place from ranked"""


SQL = _sql()
