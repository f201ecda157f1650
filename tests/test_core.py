"""Operators on small hand-made graphs and sources, whatever the tables hold."""

import ast
import json
import subprocess
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from refgraph.functions import grams as runs
from refgraph.operators import graph, joins, layout, routes, similarity
from refgraph.plans import registry
from refgraph.sources import code, declared
from refgraph.streaming import census


@pytest.fixture(params=["one task", "distributed"])
def way(request, monkeypatch):
    """Small graphs are searched by one task; the distributed loops must give the same."""
    if request.param == "distributed":
        monkeypatch.setattr(graph, "SMALL", -1)


@pytest.fixture
def few(spark):
    """One partition a shuffle, as hundreds of small rounds are made."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def edges(spark, text, strong=True):
    rows = [(a, b, 1.0, strong if len(r) == 0 else r[0] != "?") for e in text.split() for a, b, *r in [[*e[:2], *e[2:]]]]
    return spark.createDataFrame(rows, "src string, dst string, w double, strong boolean")


def ids(spark, text):
    return spark.createDataFrame([(x,) for x in text], "id string")


@pytest.mark.parametrize(
    "refs, kind, guard, sink, want",
    [
        ("RG GS", "crosses", "G", "S", "PASS"),
        ("RG GS RS", "crosses", "G", "S", "BROKEN"),
        ("RG GS RA AB BS", "crosses", "G", "S", "BROKEN"),
        ("RG RS", "requires", "G", "S", "PASS"),
        ("RG RS TS", "requires", "G", "S", "BROKEN"),
        ("RA BS", "cannot_reach", "", "S", "PASS"),
        ("RA AS", "cannot_reach", "", "S", "BROKEN"),
        ("RG GS RS?", "crosses", "G", "S", "SUSPECT"),
        ("RG GS", "crosses", "GS", "S", "EMPTY"),
        ("RG GS", "crosses", "G", "", "EMPTY"),
        ("RG GS", "crosses", "", "S", "EMPTY"),
        ("AB", "cannot_reach", "", "R", "BROKEN"),
    ],
)
def test_contracts(few, spark, refs, kind, guard, sink, want):
    source = "RT" if "T" in refs else "R"
    one = (ids(spark, source), ids(spark, sink), ids(spark, guard))
    assert routes.verify([("it", kind, *one), ("bad", "crossing", *one)], edges(spark, refs)) == [("it", want), ("bad", "EMPTY")]


def test_chokepoints_and_proposals(few, spark):
    e = edges(spark, "RA AB AC BD CD DS RG GX DG").select("src", "dst").cache()
    source, sink = ids(spark, "R"), ids(spark, "S")
    assert routes.shortest(source, sink, e) == ["R", "A", "B", "D", "S"]
    assert sorted(routes.chokepoints(source, sink, e)) == ["A", "D"]
    mass = spark.createDataFrame([(x, i / 10) for i, x in enumerate("ABCD")], "id string, mass double")
    # B and C are called by A alone, so without their callers nothing is left.
    assert routes.propose(source, sink, e, mass) == [("crosses", "D", 0.3), ("requires", "C", 0.2), ("requires", "B", 0.1), ("crosses", "A", 0.0)]
    assert routes.propose(source, ids(spark, "Q"), e, mass) == [] and routes.chokepoints(source, ids(spark, "Q"), e) == []


def test_contracts_look_to_the_end_of_a_chain(few, spark):
    chain = spark.createDataFrame([(i, i + 1, i < 40) for i in range(300)], "src long, dst long, strong boolean").cache()
    at = lambda x: spark.createDataFrame([(x,)], "id long")
    assert routes.verify([("far", "cannot_reach", at(0), at(40), at(0))], chain) == [("far", "BROKEN")]
    reached = graph.depths(at(0), chain.select("src", "dst"))
    assert graph.path(reached, 300) == list(range(301))


def test_witness_is_the_least(way, spark):
    reached = graph.depths(ids(spark, "R"), edges(spark, "RB RA AS BS SX XR"))
    assert graph.path(reached, "S") == ["R", "A", "S"] and graph.path(reached, "Q") == []
    assert {r.id: r.depth for r in reached.collect()} == {"R": 0, "A": 1, "B": 1, "S": 2, "X": 3}


def test_long_chains_are_reached_to_their_end(way, few, spark):
    n = 210 if graph.SMALL < 0 else 500  # both are deeper than any number of rounds in graph
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    got = graph.depths(spark.createDataFrame([(0,)], "id long"), chain).agg(F.count("id"), F.max("depth")).first()
    assert tuple(got) == (n + 1, n)


def test_services_reach_the_end_of_a_chain(few, spark):
    n = 205
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long").cache()
    files = spark.createDataFrame([(i, f"f{i}") for i in range(n + 1)], "id long, file string").cache()
    got = graph.services(spark.createDataFrame([("s", "f0")], "service string, file string"), files, chain, files.select("id").limit(0))
    assert got.count() == n + 1


def test_narrative_tells_eight_a_level_and_four_levels(few, spark):
    rows = [("r", f"c{i:02}", float(i), 20 - i) for i in range(10)] + [("c09", "x", 1.0, 1), ("x", "y", 1.0, 1), ("x", "r", 1.0, 2), ("y", "z", 1.0, 1), ("z", "beyond", 1.0, 1)]
    calls = spark.createDataFrame(rows, "src string, dst string, w double, place int")
    got = {tuple(r.path): r for r in graph.told(ids(spark, "r"), calls).collect()}
    first = sorted((r for p, r in got.items() if len(p) == 2), key=lambda r: r.ordinal)
    assert [r.id for r in first] == [f"c{i:02}" for i in range(9, 1, -1)] and got[("r",)].pruned == 2
    assert ("r", "c09", "x", "y", "z") in got and got[("r", "c09", "x", "r")].repeats and len(got) == 1 + 8 + 1 + 2 + 1
    inside = graph.told(ids(spark, "r"), calls, inside=spark.createDataFrame([("c00",), ("c09",)], "id string")).collect()
    assert sorted(r.id for r in inside) == ["c00", "c09", "r"]


def test_walk_returns_dangling_mass(way, spark):
    w = edges(spark, "ab ac ba")
    got = {r.id: r.mass for r in graph.walk_mass(ids(spark, "abc"), ids(spark, "a"), w).collect()}
    r, p = np.array([1.0, 0, 0]), np.array([[0, 0.5, 0.5], [1, 0, 0], [0, 0, 0]])
    for _ in range(60):
        r = 0.85 * p.T @ r + (0.15 + 0.85 * r[2]) * np.array([1.0, 0, 0])
    assert [got[x] for x in "abc"] == pytest.approx(r, abs=1e-7) and sum(got.values()) == pytest.approx(1)
    none = {r.id: r.mass for r in graph.walk_mass(ids(spark, "abc"), ids(spark, ""), w).collect()}
    assert sum(none.values()) == pytest.approx(1)


def test_visits_of_a_cycle(spark):
    got = {r.id: r.visits for r in graph.visits(ids(spark, "a"), graph.transitions(edges(spark, "ab ba"))).collect()}
    assert got["a"] == pytest.approx(1 / (1 - 0.85**2)) and got["b"] == pytest.approx(0.85 / (1 - 0.85**2))


def test_modularity_of_two_triangles(spark):
    w = edges(spark, "ab bc ca de ef fd cd")
    groups = spark.createDataFrame([(x, 1 if x in "abc" else 2) for x in "abcdef"], "id string, grp int")
    assert sum(r.q for r in graph.modularity(w, groups).collect()) == pytest.approx(2 * (6 / 14 - 0.25))
    gain = graph.merge_gain(w, groups, least=3).first()
    assert gain.gain == pytest.approx(2 * 1 / 14 - 2 * 49 / 196)


def test_levels(way, spark):
    symbols = spark.createDataFrame([("a", "f", 1, 10), ("m", "f", 2, 3), ("p", "f", 20, 21), ("w", "f", 22, 23), ("n", "f", 24, 25), ("x", "f", 30, 31)], "id string, file string, line int, end int")
    roots = spark.createDataFrame([("a", True), ("n", False)], "id string, product boolean")
    got = {}
    for r in graph.levels(symbols, roots, edges(spark, "ap mw?"), joins.nested(symbols, 5)).collect():
        got.setdefault(r.level, set()).add(r.id)
    assert got == {"PRODUCT": {"a", "p"}, "PRODUCT_WEAK": {"m", "w"}, "NOT_PRODUCT": {"n"}, "BY_NESTING": {"m", "w"}, "DEAD": {"x"}}
    more = symbols.unionByName(spark.createDataFrame([("y", "g", 1, 2), ("z", "g", 3, 4)], symbols.schema))
    imported = spark.createDataFrame([("f", "x", True), ("g", "y", False)], "file string, dst string, strong boolean")
    got = {(r.id, r.level) for r in graph.levels(more, roots, edges(spark, "ap mw?"), joins.nested(more, 5), imported).collect()}
    assert {("x", "PRODUCT"), ("y", "NOT_PRODUCT"), ("z", "DEAD")} <= got and ("x", "DEAD") not in got  # f holds a product root


def test_condensed_chain(spark):
    e = edges(spark, "ab bc cd de xf ef yz zy")
    nodes = spark.createDataFrame([(x, "L" if x in "ab" else "R") for x in "abcdefxyz"], "id string, lane string")
    got = {r.id: r.head for r in graph.condensed(e, nodes).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f", "x": "x", "y": "y", "z": "z"}


def test_islands(spark):
    chain = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 50)]
    nodes = spark.createDataFrame([(i, "f" if i < 45 else "g") for i in [*range(31), 40, 41, 50]], "id long, file string")
    got = {r.id: r.island for r in graph.islands(spark.createDataFrame(chain, "src long, dst long"), nodes).collect()}
    assert {got[i] for i in range(31)} == {0} and got[41] == 40 and got[50] == 50


def test_mcl_matches_dense(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    w = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src int, dst int, w double")
    got = {r.id: r.cluster for r in graph.mcl(w, spark.range(6).select(F.col("id").cast("int").alias("id")), rounds=12).collect()}
    a = np.zeros((6, 6))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    np.fill_diagonal(a, a.max(axis=1))
    m = a / a.sum(axis=0)
    for _ in range(12):
        m = (m @ m) ** 2
        m[m < 1e-5] = 0
        m /= m.sum(axis=0)
    want = {j: int(np.argmax(np.round(m[:, j], 6))) for j in range(6)}
    assert got == want and len({got[0], got[1], got[2]}) == 1 and got[0] != got[5]


def _dense_mcl(a, inflation, rounds):
    np.fill_diagonal(a, np.where(a.max(axis=1) > 0, a.max(axis=1), 1.0))
    m = a / a.sum(axis=0)
    for _ in range(rounds):
        m = (m @ m) ** inflation
        m[m < 1e-5] = 0
        m /= m.sum(axis=0)
    return [int(np.argmax(np.round(m[:, j], 6))) for j in range(len(m))]


def _dense_q(a, parts):
    m2 = a.sum()
    return sum(a[np.ix_(i, i)].sum() / m2 - (a[i].sum() / m2) ** 2 for g in set(parts) for i in [[k for k, x in enumerate(parts) if x == g]] if len(i) >= 2)


def test_sweep_and_submodules_match_dense(few, spark):
    one = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]  # two triangles and a bridge
    two = [(6, 7), (7, 8), (6, 8), (8, 9), (9, 6), (9, 7)]  # a clique
    hub = [(10, k) for k in range(10)]
    frame = lambda pairs: spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src int, dst int, w double")
    groups = spark.createDataFrame([(k, "m" if k < 6 else "n") for k in range(10)] + [(10, "hub")], "id int, grp string")
    a = np.zeros((10, 10))
    for x, y in one + two:
        a[x, y] = a[y, x] = 1
    got = {r.inflation: r for r in graph.swept(frame(one + two + hub), groups, (1.6, 2.0), least=3, rounds=8, top=None).collect()}
    assert got[None].k == 2 and got[None].q == pytest.approx(_dense_q(a, [0] * 6 + [1] * 4))  # without the hub, as are the others
    for r in (1.6, 2.0):
        parts = _dense_mcl(a.copy(), r, 8)
        assert got[r].q == pytest.approx(_dense_q(a, parts)) and got[r].k == sum(parts.count(x) >= 3 for x in set(parts))
    sub = {r.module: r for r in graph.submodules(frame(one + two + [(5, 6)]), groups, (1.6, 2.0), symbols=4, least=3, rounds=8).collect()}
    assert set(sub) == {"m", "n"}
    for name, own in (("m", range(6)), ("n", range(6, 10))):
        inner = a[np.ix_(own, own)]
        best = max((_dense_q(inner, _dense_mcl(inner.copy(), r, 8)), -r) for r in (1.6, 2.0))
        assert sub[name].q == pytest.approx(max(best[0], 0.0), abs=1e-9) and sub[name].cohesion == pytest.approx(inner.sum() / (inner.sum() + 1))
    assert sub["m"].k == 2


def test_forks_at_runtime(spark):
    calls = spark.createDataFrame([("f", c, br, d) for c, br, d in [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "z"), (3, "a", "z"), (3, "b", "q"), (4, "a", "x"), (4, "b", "y"), (4, "c", "z"), (5, "a", "x")]], "src string, cond int, branch string, dst string")
    got = {r.cond: r.runtime for r in graph.forks_at_runtime(calls, ids(spark, "xy")).collect()}
    assert got == {1: "every branch happens", 2: "compatible with a", 3: "no branch observed", 4: "some happen"}


def test_island_verdicts(spark):
    rows = [("big", i, 0) for i in range(8)] + [("big", 8, 8), ("big", 9, 9)] + [("split", i, i // 3) for i in range(12)] + [("loose", i, i) for i in range(10)] + [("few", i, 0) for i in range(3)]
    labels = spark.createDataFrame(rows, "file string, id int, island int")
    tight = spark.createDataFrame([("big", 0.01), ("split", 0.5)], "grp string, cohesion double")
    assert {r.file: r.verdict for r in graph.island_verdicts(labels, tight).collect()} == {"big": "one big thing", "split": "split along the islands", "loose": "not cohesive"}


def test_runs_of_words_equal_expressions(spark):
    texts = ["a b c d e f g", "a b", "", None, "  x\ty  z w q\n", "a b c d e a b c d e", "\u00e9 \u00fc b c d e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", similarity.grams(F.col("t")).alias("g"), similarity.signature(F.col("t"), 3).alias("s"), runs.hashed(F.col("t")).alias("h"))
    import hashlib

    for r in df.collect():
        assert list(r.s) == sorted(hashlib.md5(g.encode()).hexdigest() for g in r.g or ())[:3] and len(set(r.h)) == len(r.h) == len(r.g or ())


def test_quota(spark):
    sites = spark.createDataFrame([(1, "o", "n", 1.0, True), (2, "o", "t", 0.25, False), (3, "o", "?", 1.0, True)], "site int, owner string, name string, strength double, lexical boolean")
    symbols = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "n"), ("d", "n"), ("e", "t"), ("f", "t")], "id string, name string")
    got = {r.id: r.weight for r in joins.weights(joins.resolve(sites, symbols)).collect()}
    assert got == dict.fromkeys("abcd", 0.25) | dict.fromkeys("ef", 0.125)


def test_sketch_estimate(spark):
    row = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "c", "d", "e", "f"])], "x array<string>, y array<string>")
    assert row.select(similarity.estimate(F.col("x"), F.col("y")).alias("j")).first().j == 0.75  # {a,b,c,d} of the union, 3 in both


def test_prefix_ties_and_fallback(spark):
    groups = spark.createDataFrame([("first", "ab", 0), ("second", "ab", 1), ("long", "abc", 2), ("all", "z", 3)], "name string, prefix string, ordinal int")
    items = spark.createDataFrame([("abx",), ("abcx",), ("q",)], "f string")
    assert {r.f: r.group for r in joins.longest_prefix(items, "f", groups, F.lit("none")).collect()} == {"abx": "first", "abcx": "long", "q": "none"}


def test_scope_rules(spark):
    def bound(text):
        return code.bound_names(ast.parse(text).body[0])

    assert bound("def f(a, *b, c=1, **d):\n  x = 1") == {"a", "b", "c", "d", "x"}
    assert bound("def f():\n  global g\n  g = 1\n  return g") == set()
    assert bound("def f():\n  y = [h for h in z]\n  h()") == {"y"}
    assert bound("def f():\n  y = [h for h in z]\n  w = {h: 1 for h in z}") == {"y", "w", "h"}
    assert bound("def f():\n  def n():\n    q = 1\n  import os\n  try:\n    pass\n  except E as e:\n    pass") == {"e"}


def test_bad_and_empty_sources(spark):
    rows = [("p", "a.py", "def ("), ("p", "b.py", None), ("p", "c.py", ""), ("p", "d.py", "x = 1\n" * 3000)]
    got = code.facts(spark.createDataFrame(rows, "project string, file string, text string"))
    assert [(r.file, r.kind) for r in got.collect()] == [("a.py", "broken")]


def test_warm_index_equals_cold(spark):
    unit = lambda *rows: spark.createDataFrame([(f, n, 1, h, s) for f, n, h, s in rows], "file string, name string, line int, content_hash string, skeleton string")
    old = unit(("a", "f", "1", "p q r s t u v"), ("b", "g", "1", "k l m n o p q"), ("gone", "h", "1", "x"))
    new = unit(("a", "f", "1", "p q r s t u v"), ("b", "g", "2", "k l m n o p z"), ("c", "i", "1", "p q r s t u v"))
    warm = declared.refreshed(declared.clone_index(old), new)
    assert sorted(map(str, warm.collect())) == sorted(map(str, declared.clone_index(new).collect()))
    got = declared.gate(spark.createDataFrame([("n", "g", "p q r s t u v")], "file string, name string, skeleton string"), warm).collect()
    assert {(r.kind, r.file) for r in got} == {("name", "b"), ("identical", "a")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "build").mkdir()
    (tmp_path / "build/b.py").write_text("x = 1\n")
    assert [(r.file, r.text) for r in code.read(spark, str(tmp_path)).collect()] == [("pkg/a.py", "def f():\n    return 1\n")]
    (tmp_path / "bin").write_bytes(b"\xff\xfe\x00")
    assert {r.path.rsplit("/", 1)[1] for r in declared.texts(spark, str(tmp_path)).collect()} == {"a.py", "b.py"}
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "-A"), git("commit", "-qm", "one")
    assert {r.file for r in declared.commits(spark, str(tmp_path)).collect()} == {"pkg/a.py", "build/b.py", "bin"}
    assert {(r.file, r.text) for r in declared.snapshot(spark, str(tmp_path), "HEAD").collect()} == {("pkg/a.py", "def f():\n    return 1\n"), ("build/b.py", "x = 1\n")}
    (tmp_path / "w.toml").write_text('[[lane]]\nname = "l"\n[[stage]]\nname = "s"\n')
    assert declared.walkthrough(str(tmp_path / "w.toml")) == {"lane": ({"name": "l"},), "stage": ({"name": "s"},), "cut": ()}
    (tmp_path / "c.toml").write_text('[project]\nname = "x"\n[modules]\nm = ["a/", "b/"]\n[exclude]\npatterns = ["t"]\n')
    config = declared.load(str(tmp_path / "c.toml"))
    assert [tuple(r) for r in config.groups(spark).collect()] == [("m", "a/", 0), ("m", "b/", 1)] and config.alike == 0.8 and config.skipped == ("t",)
    assert declared.discover(str(tmp_path / "pkg"), "c.toml") == str(tmp_path / "c.toml")
    e = spark.createDataFrame([("a", 'b"', 2.0)], "src string, dst string, w double")
    assert '-->|2|' in declared.mermaid(e) and json.loads(declared.json_lines(e, "bounded").first().json)["caveat"] == "bounded"
    calls = spark.createDataFrame([("r", "a", 1.0, 1), ("r", "b", 2.0, 2), ("a", "r", 1.0, 1)], "src string, dst string, w double, place int")
    drawn = declared.sequence_diagram(graph.told(ids(spark, "r"), calls)).split("\n")
    assert drawn == ["sequenceDiagram", "  participant p0 as r", "  participant p1 as a", "  participant p2 as b", "  p0->>p1: calls", "  p1->>p0: again", "  p0->>p2: calls"]
    from refgraph.plans.code import _FOLDER
    from refgraph.sources import bootstrap

    folder = spark.createDataFrame(_FOLDER, "project string, file string, text string")
    first = bootstrap.starter(bootstrap.detected(folder, code.facts(folder)), 'a "b"')
    import tomllib as toml

    made = toml.loads(first)
    assert made["project"] == {"name": 'a "b"', "root": "src"} and made["roots"]["decorators"] == ["tool"] and made["roots"]["entries"] == ["src/main.py", "src/server.py"] and "# maybe: once" in first
    path = declared.written(e, str(tmp_path / "index"))
    assert spark.read.parquet(path).count() == 1
    import tomllib

    assert tomllib.loads(declared.toml_locks([("a", "b", "crosses", 'g"')]))["locks"][0]["guarantee"] == 'g"'


def test_census_batch_and_stream(spark, tmp_path):
    rows = [{"f": "a.py", "q": "C.m", "l": 3, "t": 20}, {"f": "a.py", "q": "C.m", "l": 4, "t": 10}, {"f": "b.py", "q": "g", "l": 1, "t": 5}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"f": "cut')
    want = {("a.py", "m", 4, 10), ("b.py", "g", 1, 5)}
    assert {tuple(r) for r in census.first_seen(census.read(spark, str(tmp_path))).collect()} == want
    for name, frame, mode in (("first", census.first_seen(census.read(spark, str(tmp_path), stream=True)), "update"), ("once", census.new_sightings(census.read(spark, str(tmp_path), stream=True)), "append"), ("active", census.active(census.read(spark, str(tmp_path), stream=True)), "update")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    assert {tuple(r) for r in spark.table("first").collect()} >= want
    assert spark.table("once").count() == 2
    assert {(r.f, r.sightings) for r in spark.table("active").collect()} == {("a.py", 2), ("b.py", 1)}


def test_layout():
    assert layout.longest_layers(list("abc"), {"a": ["b"], "b": ["c"]}) == {"a": 2, "b": 1, "c": 0}
    cyclic = layout.longest_layers(list("ab"), {"a": ["b"], "b": ["a"]})
    assert max(cyclic.values()) <= 2


def test_order_of_rows_does_not_matter(spark):
    t = registry.Tables(spark, "/root/testdata/sf0.001")

    class Shuffled(registry.Tables):
        def __getitem__(self, name):
            return super().__getitem__(name).orderBy(F.rand(3)).repartition(7)

    from refgraph.plans import flows, structure

    for f in (structure.hub_removal, structure.name_resolution_quota, structure.map_rollup_edges, flows.depth_from_roots, structure.cochange_pairs):
        assert sorted(map(str, f(t).collect())) == sorted(map(str, f(Shuffled(spark, t.folder)).collect())), f.__name__


def moved(spark, frame):
    """Rows of the frame and the rows that were shuffled for them."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = frame.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return rows, written() - before


def test_nearest_units_do_not_shuffle_their_pairs(spark):
    rng = np.random.default_rng(5)
    units = {u: rng.integers(0, 120, 40).tolist() for u in range(400)}
    units |= {1000 + k: units[k % 10] for k in range(50)}  # ties beyond the 30th
    words = spark.createDataFrame([(u, f"t{x}") for u, xs in units.items() for x in xs], "u int, term string")
    rows, n = moved(spark, similarity.tfidf(words, "u", share=0.9))
    df = Counter(x for xs in units.values() for x in set(xs))
    vectors = np.zeros((len(units), 120))
    for i, xs in enumerate(units.values()):
        for x, tf in Counter(xs).items():
            vectors[i, x] = (1 + np.log(tf)) * np.log(len(units) / df[x]) if df[x] < 0.9 * len(units) else 0
    vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    cosine = np.round(vectors @ vectors.T, 6)
    np.fill_diagonal(cosine, 0)
    names = list(units)
    want = {(names[a], names[b]) for a in range(len(names)) for b in np.flatnonzero((cosine[a] > 0) & (cosine[a] >= np.sort(cosine[a])[-30]))}
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)
    assert max(abs(r.cosine - cosine[names.index(r.a), names.index(r.b)]) for r in rows) < 2e-6
    assert n < 0.7 * len(units) ** 2


def test_homonyms_are_not_shuffled(spark):
    from refgraph.plans import structure

    class Same(registry.Tables):
        def __getitem__(self, name):
            frame = super().__getitem__(name)
            if name != "part":
                return frame
            frame = frame.crossJoin(spark.range(20)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 200).drop("id")
            return frame.withColumns({"p_name": F.lit("blue bolt"), "p_brand": F.lit("Brand#1"), "p_type": F.lit("SMALL")})

    t = Same(spark, "/root/testdata/sf0.001")
    lines = t["lineitem"].toPandas()
    each = lines.assign(s=np.where(lines.l_returnflag == "N", 1.0, 0.25)).groupby("l_suppkey").s.agg(["sum", "count"])
    parts = t["part"].count()
    for f in (structure.name_resolution_quota, structure.strong_edges):
        rows, n = moved(spark, f(t))
        assert len(rows) == len(each) * parts and n < 4 * len(lines) < len(rows)
        if f is structure.strong_edges:
            assert not any(r.strong for r in rows)
        else:
            assert all(r.sites == each["count"][r.owner] and abs(r.weight - each["sum"][r.owner] / parts) < 1e-6 for r in rows)


def written_texts(spark):
    """Texts with 300 copies of one, near copies, parts and a phrase that all share: (id, source, text)."""
    rng = np.random.default_rng(8)
    texts = [["same"] * 30 + [f"w{x}" for x in rng.integers(0, 50, 20)]] * 300
    for size in (8, 12, 30, 90):
        base = [f"v{x}" for x in rng.integers(0, 400, size)]
        for k in range(12):
            new = base[: size - k // 4]
            new[k % len(new)] = f"x{k % 5}"
            texts += [new, ["same"] * 30 + new]
    rows = [(i, f"s{i * 7 % 5}" if i % 11 else None, " ".join(w)) for i, w in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "id long, source string, text string")


def test_lookup_does_not_pair_copies(spark):
    rows, frame = written_texts(spark)
    n = frame.select("id", "source", F.md5(F.substring("text", 1, 200)).alias("shape"), runs.numbers(F.col("text")).alias("s")).checkpoint()
    got, shuffled = moved(spark, similarity.nearest_elsewhere(n))
    units, want = {r.id: (r.source, r.shape, list(r.s)) for r in n.collect()}, {}
    for i, (source, shape, s) in units.items():
        for o, (other, shape2, s2) in units.items():
            if source and other and source != other and (shape == shape2 or set(s) & set(s2)):
                m = min(len(s), len(s2))
                j = 1.0 if shape == shape2 else len(set(sorted({*s, *s2})[:m]) & set(s) & set(s2)) / m
                if j >= 0.75:
                    want[i] = min(want.get(i, (0, 0)), (-float(f"{j + 1e-9:.2f}"), o))
    assert {r.id: (-r.jaccard, r.found) for r in got} == want and len(got) == len(want)
    assert shuffled < 300 * 299 / 4


def test_near_pairs_do_not_shuffle_copies(spark):
    rows, frame = written_texts(spark)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, _, text in rows for w in [text.split()]}
    want = {(a, b): len(x & y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 3 and len(x & y) / len(x | y) >= 0.8}
    got, shuffled = moved(spark, similarity.near_pairs(frame, "id", "text"))
    assert {(r.a, r.b): r.common for r in got} == want and len(got) == len(want) and shuffled < 300 * 299 / 4
    side = {i: i % 3 == 0 for i in sets}
    twin = similarity.twins(frame.withColumn("new", F.col("id") % 3 == 0), "id", "text", "new").collect()
    best = {}
    for (a, b), n in want.items():
        for x, y in ((a, b), (b, a)):
            if side[x] and not side[y]:
                best[x] = min(best.get(x, (0, 0)), (-round(n / len(sets[a] | sets[b]), 6), y))
    assert {r.id: (-r.jaccard, r.twin) for r in twin} == best


def test_sides_that_grow_are_not_broadcast(spark):
    from refgraph.plans import flows, views

    t = registry.Tables(spark, "/root/testdata/sf0.001")
    for f in (flows.liveness_levels, views.census_levels):
        frame = f(t)
        frame.collect()
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString(), f.__name__


def test_group_weights_are_summed_before_directions(spark):
    pairs = [(a, b) for a in range(60) for b in range(60)]
    w = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] * 2, "src int, dst int, w double")
    groups = spark.createDataFrame([(x, x % 3) for x in range(60)], "id int, grp int")
    rows, shuffled = moved(spark, graph.cells(w, groups))
    assert {(r.a, r.b): r.w for r in rows} == {(a, b): 4.0 * (380 if a == b else 400) for a in range(3) for b in range(3)}
    assert shuffled < 60  # the cells that were kept, not pairs of nodes
    counts = similarity.cochange(spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, None), (4, "a")], "sha int, file string"), least=0.0).collect()
    assert [tuple(r) for r in counts] == [("a", "b", 2, 2 / 3)]


@pytest.mark.parametrize("flip", [False, True])
def test_many_ends_are_not_multiplied_by_cases(few, spark, flip):
    """200 sources and two ways of three nodes to the sink: each case is searched from the end of fewer nodes."""
    rows = [(f"s{i}", x) for i in range(200) for x in ("a1", "b1")] + [(f"{x}{k}", f"{x}{k + 1}") for x in "ab" for k in (1, 2)] + [("a3", "m"), ("b3", "m"), ("m", "z")]
    e = spark.createDataFrame([(b, a) if flip else (a, b) for a, b in rows], "src string, dst string")
    source, sink = spark.createDataFrame([(f"s{i}",) for i in range(200)], "id string"), ids(spark, "z")
    ends = (sink, source) if flip else (source, sink)
    tried = ["a1", "a2", "a3", "b1", "b2", "b3", "m"]
    assert routes.cutting(*ends, e, tried) == ["m"]
    want = ["a3", "b3", "m"] if flip else ["a1", "b1", "m"]  # their callers are m, or all the sources
    assert routes.cutting(*ends, e, tried, "requires") == want
    on, a, z, kept = routes.within(*ends, e.unionByName(spark.createDataFrame([("m", "out"), ("q", "m")], "src string, dst string")))
    assert {r.id for r in on.collect()} == {x for r in rows for x in r} and kept.count() == len(rows) and a.count() + z.count() == 201
