"""Operator 7: quality classifier, a factorisation machine for each of two targets (quality and toxic).

Features of a document are binary: hashed words and hashed beginnings (4 and 5 letters) of longer words, one bin for each structure
statistic, language and source. Of the hashed features a target uses all that go with its label beyond
chance (chi-square over the training rows). A target's score is w0 + sum w[i] + the sum over pairs of <v[i], v[j]>, computed in
linear time as 1/2 sum_f ((sum v[i,f])**2 - sum v[i,f]**2). A document is kept if it is likely good and not likely toxic.

Training uses at most ``TRAIN_ROWS`` labelled documents, the first by a hash of their id; the bound is a parameter. Features are
counted and chosen by an aggregation; each target's machine is then fitted by one task over the chosen features of those rows,
and the driver gets the two machines only. Scoring covers whole texts of all documents in one pass over the scan, without a shuffle; what is broadcast is the
model, whose size is bounded by the same parameter and doesn't grow with the corpus.

Defined cases: a null text counts as an empty one and is scored; null language and source are values of their own. Label
rows with a null are ignored; of contradicting label rows all take part; of documents with one id the one whose text has the
least hash is the one trained on. Very long texts are read whole, by themselves if longer than a slice. A probability of just 0.5
counts as good, and as toxic. If a target has no rows of both classes, its
probability is that of the one class seen, and without any labels every document is good and not toxic. Repeated rows are
scored one by one. Other columns pass through, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refgraph.llm import text as tx
from refgraph.llm.shared import rewritten

TRAIN_ROWS = 12_000
FACTORS = 4
#: Shares of each quality class at which a statistic is cut into bins.
CUTS = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
BINS = 2 * len(CUTS) + 1
CHI_SQUARE = 18.0
ROUNDS = 200
#: Weight decay of the constant, of weights and of factors.
DECAY = (0, 1e-3, 1e-3)
BEGINNINGS = (4, 5)
#: Buckets of hashed features: 2 ** BUCKET_BITS.
BUCKET_BITS = 22
STATISTICS = ("length", "upper", "marks", "bars", "symbols", "digits", "lines", "word length", "distinct", "most repeated")
#: The targets, and what a document is taken for where nothing is known.
DEFAULTS = {"quality": 1.0, "toxic": 0.0}
_GROUPS = {"marks": "!?", "bars": "|", "symbols": "#$%&*@^~<>{}[]=+_\\", "lines": "\n"}


class Target(NamedTuple):
    """What one trained machine knows: chosen buckets in order, then weights of bins and metadata after those of buckets."""

    buckets: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray


class Model(NamedTuple):
    edges: np.ndarray
    meta: dict
    targets: list[Target]


def _upper() -> np.ndarray:
    if "upper" not in tx._cache:
        tx._cache["upper"] = np.array([chr(c).isupper() for c in range(0x10000)] + [False] * (0x110000 - 0x10000))
    return tx._cache["upper"]


def _group(chars: str) -> np.ndarray:
    if chars not in tx._cache:
        tx._cache[chars] = np.isin(np.arange(0x110000), [ord(c) for c in chars])
    return tx._cache[chars]


def described(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all hashed features, the text of each (repeats included), and a row of statistics for each text."""
    plain = [t or "" for t in texts]
    cps, begin, end, first = tx.spans(plain)
    n = len(plain)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    if len(begin):
        whole = tx.span_hashes(cps, begin, end)
        longer = [np.flatnonzero(end - begin > b) for b in BEGINNINGS]  # a beginning that is the word would say it twice
        hashes = [whole] + [tx.span_hashes(cps, begin[k], begin[k] + b) ^ np.uint64(b) if len(k) else whole[:0] for b, k in zip(BEGINNINGS, longer)]
        owners = np.concatenate([owner, *(owner[k] for k in longer)])
    else:
        whole, hashes, owners = np.zeros(0, np.uint64), [np.zeros(0, np.uint64)], owner
    buckets = np.concatenate([(tx.mixed(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) for h in hashes])
    raw, starts = tx.codepoints(plain)
    chars = np.maximum(np.diff(starts) - 1, 1)

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=sums[1:])
        return sums[starts[1:] - 1] - sums[starts[:-1]]

    per_word = np.maximum(words, 1)
    stats = {"length": np.log1p(words), "upper": count(_upper()) / chars, "digits": count(_group("0123456789")) / chars}
    stats |= {k: count(_group(c)) / (chars if k == "lines" else per_word) for k, c in _GROUPS.items()}
    sums = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=sums[1:])
    stats["word length"] = (sums[first[1:]] - sums[first[:-1]]) / per_word
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (tx.mixed(whole) >> np.uint64(24)))
    fresh = np.flatnonzero(np.diff(key, prepend=~np.uint64(0)))
    whose, run = (key[fresh] >> np.uint64(40)).astype(np.int64), np.diff(np.r_[fresh, len(key)])
    stats["distinct"] = np.bincount(whose, minlength=n) / per_word
    most = np.zeros(n, np.int64)
    np.maximum.at(most, whose, run)
    stats["most repeated"] = most / per_word
    return buckets, owners, np.stack([stats[k] for k in STATISTICS], axis=1) if n else np.zeros((0, len(STATISTICS)))


def unique(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((owner.astype(np.int64) << 32) | feature)
    return key >> 32, key & 0xFFFFFFFF


def _features(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows: distinct buckets and statistics of the text (the third column) after all other columns."""
    for batch, texts in tx.batches(source, 2):
        buckets, owner, stats = described(texts)
        whose, what = unique(owner, buckets)
        lists = tx.lists(pa.array(what.astype(np.int32)), np.bincount(whose, minlength=len(texts)))
        numbers = tx.lists(pa.array(stats.ravel()), np.full(len(texts), stats.shape[1]))
        rest = [i for i in range(batch.num_columns) if i != 2]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), lists, numbers], [*(batch.schema.names[i] for i in rest), "features", "stats"])


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows of ``x`` between successive ``starts`` (one more than sums)."""
    out = np.zeros((len(starts) - 1, *x.shape[1:]), x.dtype)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(x, starts[some], axis=0)
    return out


def scored(w0: float, w: np.ndarray, v: np.ndarray, feature: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores, and the sums of factors that the gradient needs."""
    vs = v[feature]
    s = _sums(vs, starts)
    return w0 + _sums(w[feature], starts) + 0.5 * (s**2 - _sums(vs**2, starts)).sum(axis=1), s


def _gathered(x: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of x[at] between successive ``starts``."""
    return _sums(np.take(x, at), starts)


def fit(owner: np.ndarray, feature: np.ndarray, y: np.ndarray, size: int, rounds: int = ROUNDS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Full-batch Adam on the logistic loss with weight decay; ``owner`` ascending.

    Both directions are sums over sorted runs: scores over the features of a row, gradients over the rows of a feature. The
    gradient of v[i,f] is the sum of e * (s[f] - v[i,f]) over those rows, that is, the sum of e * s[f] less v[i,f] times that of e.
    """
    rng = np.random.default_rng(seed)
    n = len(y)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w0, w, v = np.array([np.log(rate / (1 - rate))]), np.zeros(size, np.float32), np.ascontiguousarray(rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32).T)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w0, w, v)]
    starts = np.searchsorted(owner, np.arange(n + 1))
    by_feature = np.argsort(feature, kind="stable")
    rows, begins = owner[by_feature], np.searchsorted(feature[by_feature], np.arange(size + 1))
    for t in range(1, rounds + 1):
        s = [_gathered(x, feature, starts) for x in v]
        z = w0[0] + _gathered(w, feature, starts) + 0.5 * (sum(x**2 for x in s) - _gathered((v**2).sum(axis=0), feature, starts))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        e = err.astype(np.float32)
        gw = _gathered(e, rows, begins)
        gv = np.stack([_gathered(e * x, rows, begins) for x in s]) - v * gw
        for p, m, g, decay in zip((w0, w, v), moments, (np.array([err.sum()]), gw, gv), DECAY):
            g = g + decay * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g**2
            p -= 0.1 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-9)
    return float(w0[0]), w, np.ascontiguousarray(v.T)


def chosen(counts: DataFrame, n: int, positive: dict[str, int]) -> dict[str, np.ndarray]:
    """For each target, in order, the buckets whose presence goes with its label beyond chance; counts(bucket, df, and for each
    target how many of those rows have its label). Decided where the counts are; the driver gets only what is chosen."""
    df, tests = F.col("df").cast("double"), {}
    for name, pos in positive.items():
        expected = df * pos / n
        spread = F.greatest(expected * (1 - pos / n) * (1 - df / n), F.lit(1e-9))
        tests[name] = (df >= 3) & ((F.col(name) - expected) ** 2 / spread > CHI_SQUARE)
    if not tests:
        return {}
    passed = counts.select("bucket", *(test.alias(name) for name, test in tests.items())).where(" or ".join(tests)).orderBy("bucket").toArrow()
    bucket = np.asarray(passed["bucket"]).astype(np.int64)
    return {name: bucket[np.asarray(passed[name])] for name in tests}


def _dense(edges: np.ndarray, meta: dict, stats: np.ndarray, lang: list, source: list) -> np.ndarray:
    """Numbers of the bins and of the metadata of each row; -1 for metadata never trained on."""
    columns = [np.searchsorted(edges[i], stats[:, i], "right") + i * BINS for i in range(stats.shape[1])]
    columns += [np.array([meta.get((k, x), -1) for x in values], np.int64) for k, values in (("lang", lang), ("source", source))]
    return np.stack(columns, axis=1)


def _examples(edges: np.ndarray, meta: dict, chosen_of: dict[str, np.ndarray]):
    """Training rows of each target: (target, id, y, the numbers of all its features)."""

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n = batch.num_rows
            if not n:
                continue
            lists = batch["features"]
            bucket, whose = np.asarray(lists.flatten()), np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
            stats = np.asarray(batch["stats"].flatten()).reshape(n, len(STATISTICS))
            dense = _dense(edges, meta, stats, batch["lang"].to_pylist(), batch["source"].to_pylist())
            for name, buckets in chosen_of.items():
                at = np.minimum(np.searchsorted(buckets, bucket), max(len(buckets) - 1, 0))
                hit = np.flatnonzero(buckets[at] == bucket) if len(buckets) else np.zeros(0, np.int64)
                owner = np.r_[whose[hit], np.repeat(np.arange(n), dense.shape[1])]
                feature = np.r_[at[hit], len(buckets) + dense.ravel()].astype(np.int32)
                order = np.argsort(owner, kind="stable")
                out = tx.lists(pa.array(feature[order]), np.bincount(owner, minlength=n))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), batch["id"], batch[name], out], ["target", "id", "y", "features"])

    return run


def _fitted(size: dict[str, int]):
    """The machine of one target; its group has at most ``TRAIN_ROWS`` rows."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("y", "ascending")]).combine_chunks()
        name, lists = group["target"][0].as_py(), group["features"].chunk(0)
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), np.asarray(lists.value_lengths()))
        w0, w, v = fit(owner, np.asarray(lists.flatten()), np.asarray(group["y"]).astype(float), size[name])
        flat = lambda x: tx.lists(pa.array(x.astype(np.float32).ravel()), np.array([x.size]))
        return pa.Table.from_arrays([pa.array([name]), pa.array([w0]), flat(w), flat(v)], ["target", "w0", "w", "v"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rows: int = TRAIN_ROWS) -> Model:
    known = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").where("id is not null and quality is not null and toxic is not null").distinct()
    known = known.orderBy(F.xxhash64("id"), "id", "quality", "toxic").limit(rows)
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    joined = wanted.join(F.broadcast(known), "id").select(F.col("id").cast("string").alias("id"), F.xxhash64("text").alias("th"), "text", "lang", "source", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    made = joined.mapInArrow(_features, "id string, th long, lang string, source string, quality int, toxic int, features array<int>, stats array<double>")
    once = made.groupBy("id", "quality", "toxic").agg(F.min_by(F.struct("lang", "source", "features", "stats"), F.struct("th", "lang", "source")).alias("x"))
    table = rewritten(once.select("id", "quality", "toxic", "x.*"))
    small = table.drop("features").toArrow()
    n = small.num_rows
    stats = np.asarray(small["stats"].combine_chunks().flatten()).reshape(n, len(STATISTICS)) if n else np.zeros((0, len(STATISTICS)))
    edges = np.zeros((len(STATISTICS), BINS - 1))
    for k in range(2):
        of = np.asarray(small["quality"]) == k
        edges[:, k::2] = np.quantile(stats[of if of.any() else slice(None)], CUTS, axis=0).T if n else 0
    edges.sort(axis=1)
    seen = {(k, x) for k in ("lang", "source") for x in set(small[k].to_pylist())}
    meta = {k: i + len(STATISTICS) * BINS for i, k in enumerate(sorted(seen, key=str))}
    extra = len(STATISTICS) * BINS + len(meta)
    positive = {name: int(np.asarray(small[name]).sum()) for name in DEFAULTS}
    both = {name: k for name, k in positive.items() if 0 < k < n}
    counts = table.select(F.explode("features").alias("bucket"), *both).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), *(F.sum(x).alias(x) for x in both))
    buckets = chosen(counts, n, both)
    found = {}
    if both:
        examples = table.mapInArrow(_examples(edges, meta, buckets), "target string, id string, y int, features array<int>")
        size = {name: len(x) + extra for name, x in buckets.items()}
        fitted = examples.groupBy("target").applyInArrow(_fitted(size), "target string, w0 double, w array<float>, v array<float>")
        for r in fitted.toArrow().to_batches():
            for i in range(r.num_rows):
                w, v = (np.asarray(r[c].slice(i, 1).flatten()) for c in ("w", "v"))
                found[r["target"][i].as_py()] = r["w0"][i].as_py(), w, v.reshape(-1, FACTORS)
    targets = []
    for name, default in DEFAULTS.items():
        if name in found:
            targets.append(Target(buckets[name], *found[name]))
        else:
            p = float(positive[name] > 0) if n else default
            targets.append(Target(np.zeros(0, np.int64), 30.0 * (2 * p - 1), np.zeros(extra, np.float32), np.zeros((extra, FACTORS), np.float32)))
    return Model(edges, meta, targets)


def probabilities(model: Model, texts: list[str | None], lang: list, source: list) -> list[np.ndarray]:
    bucket, owner, stats = described(texts)
    dense = _dense(model.edges, model.meta, stats, lang, source)
    known = np.flatnonzero(dense.ravel() >= 0)
    row = known // dense.shape[1]
    out = []
    for t in model.targets:
        seen = np.zeros(1 << BUCKET_BITS, bool)
        seen[t.buckets] = True
        hit = np.flatnonzero(seen[bucket])
        whose, what = unique(owner[hit], np.searchsorted(t.buckets, bucket[hit]))
        whose, what = np.r_[whose, row], np.r_[what, len(t.buckets) + dense.ravel()[known]]
        order = np.argsort(whose, kind="stable")
        z, _ = scored(t.w0, t.w, t.v, what[order], np.searchsorted(whose[order], np.arange(len(texts) + 1)))
        out.append(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))))
    return out


def scores(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(row, p_quality, p_toxic, keep): each row as a struct with its probabilities."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.batches(source, 1):
            good, toxic = probabilities(held.value, texts, batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(toxic), pa.array((good >= 0.5) & (toxic < 0.5))], ["row", "p_quality", "p_toxic", "keep"])

    source = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    out = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("p_quality", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return source.mapInArrow(score, out)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, p_quality, p_toxic): the documents that the classifier keeps, each as a struct of all its columns."""
    return scores(docs, train(docs, labels)).where("keep").drop("keep")
