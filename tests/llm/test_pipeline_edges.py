"""The five stages as composed, on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from refgraph.llm.shared import rewritten
from refgraph.session import ship

LONG = " ".join(f"word{i}" for i in range(40_000))
ITEM = " ".join(f"item{i}" for i in range(30))
BLOCK = "\n".join(f"line {i} of a block that comes again" for i in range(4))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, th string, keep boolean, tokens int, bucket string, a int"
ROWS = [
    (1, None, "en", "s", None), (2, "", None, None, 0), (None, "a text without an id, long enough to be one", "en", "s", 43), (3, "one", "en", "s", 3), (4, LONG, "en", "s", len(LONG)),
    (5, "the same text in two rows, word for word", "en", "s", 40), (5, "the same text in two rows, word for word", "en", "s", 40), (6, "the same text in two rows, word for word", "de", "t", 40),
    (7, BLOCK + "\nthe end of seven", "en", "s", len(BLOCK) + 17), (8, "another start for eight\n" + BLOCK, "en", "s", 0), (9, BLOCK, "en", "s", len(BLOCK)), (10, f"before {ITEM} after", "en", "s", 9), (11, "!!! ???", "en", "s", 7),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    ship(spark)
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(3, 1, 0), (5, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def _through(spark, docs, folder):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(rewritten(stage(spark, out[-1], folder)))
    return out


def test_stages_on_edge_cases(spark, folder):
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash", False, 7, None, 1) for r in ROWS], SCHEMA).repartition(3)
    _, kept, cut, one, clean, packed = _through(spark, docs, folder)
    ids = lambda x: sorted((r.doc_id for r in x.collect()), key=lambda i: (i is None, i))
    assert kept.columns == cut.columns == one.columns == clean.columns == docs.columns
    assert ids(kept) == ids(docs)  # all labels are good: nothing is known against any
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert texts[7] == (BLOCK + "\nthe end of seven", len(BLOCK) + 17) and texts[8] == ("another start for eight", 23) and 9 not in texts  # all its lines went
    assert texts[1] == (None, None) and texts[2] == ("", 0) and texts[4] == (LONG, len(LONG)) and len(ids(cut)) == len(ROWS) - 1
    assert ids(one) == [1, 2, 3, 4, 5, 7, 8, 10, 11, None]  # of three equal texts one row
    assert ids(clean) == [1, 2, 3, 4, 5, 7, 8, 11, None]
    got = {r.doc_id: r.tokens for r in packed.collect()}
    assert sorted(got, key=str) == sorted(ids(clean), key=str) and got[4] == 40_000 and got[1] == got[2] == 0 and got[11] == 6


def test_stages_on_empty_tables(spark, folder, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert [x.count() for x in _through(spark, docs, folder)] == [0] * 6
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15), (2, "other words there", "en", "s", 17)], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [x.count() for x in _through(spark, docs, str(tmp_path))] == [2] * 6
