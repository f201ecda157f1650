"""Operator 6: URL filter. Host names are segmented into words, and multinomial naive Bayes scores host and path tokens.

Segmentation: a unigram Viterbi over each host label. The unigram counts are those of the words of all pages' visible text
and URL paths (a host isn't a word of its own just because it is a host), counted by an aggregation. No vocabulary is broadcast:
every distinct label is cut into its substrings of up to ``ANCHOR`` letters, those join the counts; longer words meet the labels on
their first ``ANCHOR`` letters and are compared whole. What joined comes back to its label, whose best split is then found among
the words that do occur; a substring that is no word costs ``log(10 / (N * 10 ** letters))``. Of equally likely splits the one
with the shortest last word wins, and so on backwards.

Classes: there are no labels for pages. A URL whose host has a word of ``SEEDS`` (a parameter, like a domain list) is listed, and
is a training example of the bad class; every other is one of the good class. So that the model doesn't learn its own list, words of ``SEEDS``
are no tokens: it learns and scores what goes with them. The classes' token counts come from all URLs; smoothing is add-one. A
URL's score is the log odds of bad, with host words counted as ``h:word`` and path words as ``p:word``. A URL is bad if it is
listed or its log odds are above the threshold. Tokens join their weights; only the class totals reach the driver.

Defined cases: a null or unparsable URL has no tokens and is scored with the prior alone; upper case is lowered. If there is
no bad (or no good) example, the log odds are those of smoothed counts, still finite. A null page text adds no words; a very long
one adds all its words, and a label of any length is split. Log odds are rounded to six digits; those that equal the threshold
aren't bad. Repeated rows each give a row; ids may be null. Other columns are never read, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refgraph.llm.shared import ready

SEEDS = ("ads", "adult", "bets", "betting", "casino", "escort", "loans", "lottery", "pills", "poker", "porn", "slots", "spam", "viagra", "xxx")
#: Words of more letters meet labels on so many first ones.
ANCHOR = 24
THRESHOLD = 0.0
WORD = r"[\p{L}]+"


def unigrams(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(word, n) over visible text and URL paths of all pages."""
    path = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    visible = F.regexp_replace(F.regexp_replace(F.col(html_col), r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    words = F.concat(F.coalesce(F.regexp_extract_all(F.lower(visible), F.lit(f"({WORD})")), F.array().cast("array<string>")), F.coalesce(F.regexp_extract_all(path, F.lit(f"({WORD})")), F.array().cast("array<string>")))
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_label(label: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """Most likely words of ``label``; known: (begin, end) of substrings that are words, with their counts.

    Of substrings that are no words, the best one that ends at a place begins where the best one that ended a letter before
    did, or is that letter alone; so the cost is that of the known ones and the letters.
    """
    n, ten = len(label), math.log(10.0)
    ending: dict[int, list[tuple[int, int]]] = {}
    for (begin, end), count in known.items():
        ending.setdefault(end, []).append((begin, count))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    other = 0  # where the best substring that is no word begins
    for end in range(1, n + 1):
        if best[end - 1] + (end - 1) * ten >= best[other] + other * ten - 1e-9:
            other = end - 1
        ways = [(best[begin] + math.log(count / total), begin) for begin, count in ending.get(end, ())]
        ways.append((best[other] + ten - math.log(total) - (end - other) * ten, other))
        top = max(p for p, _ in ways)
        best[end], back[end] = top, max(begin for p, begin in ways if p >= top - 1e-9)
    out = []
    while n:
        out.append(label[back[n] : n])
        n = back[n]
    return out[::-1]


def segments(labels: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(label, words) for every distinct label of letters."""
    n, letters = F.length("label"), F.length("word")
    begin = labels.select("label", F.explode(F.sequence(F.lit(0), n - 1)).alias("begin"))
    cut = begin.select("label", "begin", F.explode(F.sequence(F.col("begin") + 1, F.least(n, F.col("begin") + ANCHOR))).alias("end"))
    parts = cut.select("label", "begin", "end", F.substring("label", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("word"))
    short = parts.join(counts.where(letters <= ANCHOR), "word").select("label", "begin", "end", "n")
    head = begin.where(n - F.col("begin") > ANCHOR).withColumn("head", F.substring("label", F.col("begin") + 1, F.lit(ANCHOR)))
    longer = counts.where(letters > ANCHOR).withColumn("head", F.substring("word", 1, ANCHOR))
    whole = head.join(longer, "head").where(F.substring("label", F.col("begin") + 1, letters) == F.col("word")).select("label", "begin", (F.col("begin") + letters).alias("end"), "n")
    known = short.unionByName(whole).groupBy("label").agg(F.collect_list(F.struct("begin", "end", "n")).alias("known"))

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            labels, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [split_label(x, {(k["begin"], k["end"]): k["n"] for k in ks or ()}, total) for x, ks in zip(labels, lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return labels.join(known, "label", "left").mapInArrow(run, "label string, words array<string>")


def filtered(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seeds: tuple[str, ...] = SEEDS, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host_words, listed, log_odds, bad) for every row of ``pages``."""
    ready(pages.sparkSession)
    url = F.lower(F.col(url_col))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    none = F.array().cast("array<string>")
    rows = pages.select(F.col(id_col).alias("page_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.regexp_extract_all(host, F.lit(f"({WORD})")), none).alias("labels"), F.coalesce(F.regexp_extract_all(path, F.lit(f"({WORD})")), none).alias("paths")).checkpoint()
    counts = unigrams(pages, url_col, html_col).checkpoint()
    total = counts.agg(F.sum("n")).first()[0] or 1
    split = segments(rows.select(F.explode("labels").alias("label")).distinct(), counts, total)
    hosts = rows.select("row", F.posexplode("labels").alias("place", "label")).join(split, "label").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("parts"))
    hosts = hosts.select("row", F.flatten(F.col("parts.words")).alias("host_words"))
    full = rows.join(hosts, "row", "left").select("page_id", "row", F.coalesce("host_words", none).alias("host_words"), "paths").checkpoint()
    seeded = F.arrays_overlap("host_words", F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    plain = lambda c: F.filter(c, lambda x: ~x.isin(*seeds)) if seeds else F.col(c)
    token = F.concat(F.transform(plain("host_words"), lambda x: F.concat(F.lit("h:"), x)), F.transform(plain("paths"), lambda x: F.concat(F.lit("p:"), x)))
    each = full.select("row", seeded.alias("seeded"), F.explode(token).alias("token"))
    weights = each.groupBy("token").agg(F.count_if("seeded").alias("bad"), F.count_if(~F.col("seeded")).alias("good")).checkpoint()
    bad, good, vocabulary = weights.agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
    positive, every = full.agg(F.count_if(seeded), F.count(F.lit(1))).first()
    prior = math.log((positive + 1) / (every - positive + 1))
    odds = F.log((F.col("bad") + 1) / F.lit((bad or 0) + vocabulary + 1.0)) - F.log((F.col("good") + 1) / F.lit((good or 0) + vocabulary + 1.0))
    scores = each.select("row", "token").join(weights.select("token", odds.alias("odds")), "token").groupBy("row").agg(F.sum("odds").alias("odds"))
    log_odds = F.round(F.coalesce("odds", F.lit(0.0)) + F.lit(prior), 6)
    scored = full.join(scores, "row", "left").select("page_id", "host_words", seeded.alias("listed"), log_odds.alias("log_odds"))
    return scored.withColumn("bad", F.col("listed") | (F.col("log_odds") > threshold))
