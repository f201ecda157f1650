"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

import json

import numpy as np
import pytest

from refgraph.llm import codes, decontaminate, lines, packing, pii, quality, simhash, substrings, urls, winnow
from refgraph.session import ship

LONG = " ".join(f"word{i}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, th string, row string, n int, bands string"
ROWS = [
    (1, None, "en", "s", None), (None, "a text whose id is null", "en", "s", 1), (2, "", None, None, 0), (3, "one", "en", "s", 3), (4, LONG, "en", "s", 9),
    (5, PASSAGE + " tail", "en", "s", 1), (5, PASSAGE + " tail", "en", "s", 1), (6, "head " + PASSAGE, "de", "t", 1), (7, "x\ny\nz\nmail a.b@c.example.com\nx\ny\nz", "en", "s", 1), (8, "!!! ???", "en", "s", 1), (None, None, None, None, None), (9, "z" * 30_000, "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(*r, "clash", "clash", "clash", 7, None) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short"), (1, PASSAGE), (4, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_simhash(docs):
    got = simhash.duplicates(docs).collect()
    assert sorted((r.doc_id, r.kept_id) for r in got) == [(5, 5), (6, 5)]
    kept = simhash.without_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(ROWS) - 2 and ids.count(5) == 1 and 6 not in ids and ids.count(None) == 2


def test_winnow(docs):
    got = {(r.doc_id, len(r.hashes)) for r in winnow.fingerprints(docs).collect()}
    assert {(1, 0), (2, 0), (3, 0), (8, 0), (9, 0)} <= got and len(winnow.fingerprints(docs).collect()) == len(ROWS)
    assert next(n for i, n in got if i == 4) > 60_000 / 8


def test_substrings(docs):
    got = sorted((r.doc_id, r.start, r.end) for r in substrings.repeats(docs).collect())
    assert got == [(5, 0, 61), (6, 1, 61)]


def test_passages_that_touch_stay_apart(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(1, f"{one} {two}"), (2, f"q {one} q"), (3, f"r {two}"), (4, f"{three} s"), (5, f"{three} {one}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end) for r in substrings.repeats(docs).collect())
    assert got == [(1, 0, 60), (1, 60, 120), (2, 1, 61), (3, 1, 61), (4, 0, 60), (5, 0, 60), (5, 60, 120)]


def test_lines(docs):
    got = {r.row.doc_id: (r.text, r.removed) for r in lines.deduplicated(docs).collect()}
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[7] == ("x\ny\nz\nmail a.b@c.example.com", 3) and got[4] == (LONG, 0)
    assert len(lines.deduplicated(docs).collect()) == len(ROWS)


def test_lines_that_overlap_their_first_occurrence(spark):
    texts = ["x\nx\nx\nx\ntail", "a\nb\na\nb\na\nb", "x\nx\nx\nx\nx\nx\nx", "p\nq\nr\ns\np\nq\nr", "q\nr\ns\nnew"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert got == {0: "x\nx\nx\ntail", 1: "a\nb\na", 2: "", 3: "p\nq\nr\ns", 4: "new"}


def test_packing(docs):
    got = packing.packed(docs, budget=100).collect()
    assert len(got) == len(ROWS)
    alone = next(r for r in got if r.doc_id == 4)
    assert (alone.tokens, alone.boundary, alone.place) == (60_000, 60_000, 0) and [r.doc_id for r in got if r.batch == alone.batch] == [4]
    assert sorted(r.place for r in got if r.doc_id == 5) in ([0, 0], [0, 1])


def test_packing_of_one_hot_row(spark):
    """A third of all rows are one row; they are counted before they are numbered."""
    docs = spark.range(300).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 3 = 0, 'a b c', repeat('w ', int(id))) as text")
    got = packing.packed(docs, budget=64, chunk_rows=50).toPandas()
    assert len(got) == 300 and not got.duplicated(["batch", "place"]).any() and got.doc_id.isna().sum() == 100
    assert (got.groupby("batch").size() * got.groupby("batch").boundary.first() <= 64).sum() > 3


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "", ""), (2, "http://cheapcasino.example.com/win", "<p>cheap casino win</p>"), (2, "http://cheapcasino.example.com/win", "<p>cheap casino win</p>"), (3, "not a url", "x"), (4, "http://" + "a" * 300 + ".org/" + "b/" * 500, LONG), (5, "HTTP://User@NEWS.example.com:80/a?b#c", "news")], "page_id long, url string, html string")
    got = urls.filtered(pages).collect()
    assert len(got) == 7
    assert [(r.host_words, r.bad) for r in got if r.page_id == 2] == [(["cheap", "casino", "example", "com"], True)] * 2
    assert next(r.host_words for r in got if r.page_id == 5) == ["news", "example", "com"]
    assert all(r.host_words == [] for r in got if r.page_id in (1, None, 3))
    assert urls.filtered(pages.limit(0)).count() == 0
    clash = pages.selectExpr("*", "'c' as row", "'c' as label", "'c' as labels", "'c' as paths", "'c' as token", "'c' as host_words", "'c' as word", "1 as n")
    assert sorted(map(str, urls.filtered(clash).collect())) == sorted(map(str, got))
    assert urls.filtered(pages.where("page_id = 1")).first().log_odds is not None


def test_quality(docs, labels):
    out = quality.scores(docs, quality.train(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(r.p_quality is not None and r.p_toxic is not None for r in out)
    assert quality.kept(docs, labels).select("row.*").columns == docs.columns
    none = quality.kept(docs, labels.limit(0)).collect()
    assert len(none) == len(ROWS)  # nothing is known against any
    one = quality.train(docs, labels.where("doc_id = 5"))
    assert quality.scores(docs, one).where("not keep").count() == 0


def test_quality_uses_all_telling_words(spark):
    rows = [(b, 100 if b < 400 else 200, 100) for b in range(500)] + [(500, 2, 2)]  # 400 buckets go with the label, 100 are everywhere, one is rare
    counts = spark.createDataFrame(rows, "bucket int, df long, quality long").repartition(3)
    assert quality.chosen(counts, 200, {"quality": 100})["quality"].tolist() == list(range(400))
    buckets, owner, _ = quality.described(["en abcd", "abcde", "abcdef", "abcdefg"])
    assert np.bincount(owner).tolist() == [2, 2, 3, 3]  # a beginning counts where the word is longer
    assert len(set(buckets.tolist())) == 7


def test_pii(docs, field):
    got = [(r.doc_id, r.begin, r.end, r.label) for r in pii.found(docs, field).collect()]
    assert got == [(7, 11, 28, "EMAIL")]
    assert pii.entities([None, "", " ", "=", "1"], field) == []


def test_pii_in_lines_without_blanks(field):
    def got(text):
        return [(text[a:b], label) for _, a, b, label in pii.entities([text], field)]

    data = {"mail": "jane.roe@example.com", "host": "10.20.30.40", "other": "max@mail.example.org", "password": "correcthorsebattery", "card": "4111111111111111"}
    line = json.dumps({f"field{i}": f"some_value_{i}" for i in range(182)} | data, separators=(",", ":"))
    assert len(line) > 5000 and " " not in line
    assert got(line) == list(zip(data.values(), ["EMAIL", "IP", "EMAIL", "SECRET", "CARD"]))
    assert got("ann.lee@b.com,c.d@e.org;joe@y.net|10.0.0.1") == [("ann.lee@b.com", "EMAIL"), ("c.d@e.org", "EMAIL"), ("joe@y.net", "EMAIL"), ("10.0.0.1", "IP")]
    assert got("password:correcthorse") == [("correcthorse", "SECRET")]
    assert got("the token : correcthorsebatterystaple is set") == [("correcthorsebatterystaple", "SECRET")]
    assert got("password=ab3x9qpl7:cdef99 next") == [("ab3x9qpl7:cdef99", "SECRET")]
    assert got("The secret: always be kind to people.") == []


@pytest.mark.parametrize("named, bare, label", [('api_key = "9f31c0aa7b21d4e65b0c77aa"', "9f31c0aa7b21d4e65b0c77aa", "SECRET"), ("password:tr0ub4dorplus", "tr0ub4dorplus", "SECRET"), ("mail ann.lee@web.de", "ann.lee@web.de", "EMAIL"), ("hash 9f31c0aa7b21d4e65b0c77aa", "9f31c0aa7b21d4e65b0c77aa", None)])
@pytest.mark.parametrize("place", [0, 25, 49])
def test_pii_names_all_of_fifty_mentions(field, named, bare, label, place):
    parts = [f"{'some other words ' * (1 + k % 3)}{named if k == place else bare} and more." for k in range(50)]
    text = " ".join(parts)
    got = [(text[a:b], x) for _, a, b, x in pii.entities([text], field)]
    assert got == ([(bare, label)] * 50 if label else [])


def test_codes(docs):
    got = codes.coded(docs).collect()
    enc = codes.encoder(open(codes.VOCABULARY, "rb").read())
    for r in got:
        assert (r.code is None) == (r.tokens is None)
        if r.doc_id in (4, 5, 9):
            assert enc.decode(codes.decode(bytes(r.code)).tolist()) == next(x[1] for x in ROWS if x[0] == r.doc_id)
    assert {r.tokens for r in got if r.doc_id == 2} == {0} and {r.tokens for r in got if r.doc_id == 1} == {None}


def test_decontaminate(docs, bench):
    got = sorted((r.doc_id, r.item_id, r.start, r.found, r.total) for r in decontaminate.hits(docs, bench).collect())
    assert got == [(5, 1, 0, 58, 58)] * 4 + [(6, 1, 1, 58, 58)] * 2
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {5, 6}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == len(ROWS) - 3
    assert decontaminate.hits(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(ROWS)


def test_decontaminate_in_parts(docs, bench, monkeypatch):
    more = bench.unionByName(bench.sparkSession.createDataFrame([(i, " ".join(f"other{i}x{j}" for j in range(40))) for i in range(10, 16)], bench.schema))
    whole = sorted(map(str, decontaminate.hits(docs, more).collect())), sorted(map(str, decontaminate.clean(docs, more).select("doc_id").collect()))
    monkeypatch.setattr(decontaminate, "PART_CHARS", 1500)
    assert len(list(decontaminate.parts(more, "item_id", "text"))) > 2
    assert (sorted(map(str, decontaminate.hits(docs, more).collect())), sorted(map(str, decontaminate.clean(docs, more).select("doc_id").collect()))) == whole
    for kind in ("string", "double", "date", "decimal(9,2)"):
        named = bench.selectExpr(f"cast({'date_from_unix_date(int(item_id))' if kind == 'date' else 'item_id'} as {kind}) as item_id", "text")
        got = decontaminate.hits(docs, named)
        assert got.schema["item_id"].dataType.simpleString() == kind and got.count() == 6


def test_empty_tables(docs, labels, bench, field):
    none = docs.limit(0)
    assert simhash.duplicates(none).count() == simhash.without_duplicates(none).count() == 0
    assert winnow.fingerprints(none).count() == substrings.repeats(none).count() == lines.deduplicated(none).count() == 0
    assert packing.packed(none).count() == codes.coded(none).count() == pii.found(none, field).count() == 0
    assert quality.kept(none, labels).count() == decontaminate.hits(none, bench).count() == decontaminate.clean(none, bench).count() == 0
