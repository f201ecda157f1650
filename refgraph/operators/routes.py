"""Searches that leave nodes out: contracts, chokepoints, routes.

All cases of a question are searched in one loop over (case, id) pairs, so a round costs one join however many there are; a case
that has reached its sink leaves the frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refgraph.operators import graph
from refgraph.session import checkpointing

KINDS = ("crosses", "requires", "cannot_reach")


def reaching(start: DataFrame, sink: DataFrame, edges: DataFrame, removed: DataFrame) -> list[str]:
    """The cases in which something of the sink is reached without what is removed.

    start(case, sure, id), sink(case, id), removed(case, id), edges(src, dst, strong); a case that is sure walks strong edges
    only. There are as many cases as questions, so their names come to the driver.
    """
    checkpointing(start.sparkSession)
    key = ["case", "id"]
    gone = removed.select(*key).distinct().checkpoint()
    goal = sink.select(*key).distinct().join(gone, key, "left_anti").checkpoint()
    level = start.select("case", "sure", "id").distinct().join(gone, key, "left_anti").checkpoint()
    seen, found, rounds = level, set(), 0
    while True:
        found |= {r["case"] for r in level.join(goal, key, "left_semi").select("case").distinct().collect()}
        if found:
            level = level.where(~F.col("case").isin(*found))
        new = level.join(edges, level["id"] == edges["src"]).where(~F.col("sure") | F.col("strong")).select("case", "sure", F.col("dst").alias("id")).distinct()
        level = new.join(gone, key, "left_anti").join(seen.select(*key), key, "left_anti").select("case", "sure", "id").checkpoint()
        if level.isEmpty():
            return sorted(found)
        seen, rounds = seen.unionByName(level), rounds + 1
        if rounds % 16 == 0:
            seen = seen.checkpoint()


def callers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(case, id) of what refers to ids(case, id)."""
    return ids.withColumnRenamed("id", "dst").join(edges, "dst").select("case", F.col("src").alias("id"))


def removal(kind: str, guarantee: DataFrame, edges: DataFrame) -> DataFrame | None:
    """(case, id) that a contract's check takes away, callers counted on the edges that are walked; guarantee(case, id)."""
    return None if kind == "cannot_reach" else guarantee if kind == "crosses" else guarantee.unionByName(callers(edges, guarantee))


def verify(specs: list[tuple[str, str, DataFrame, DataFrame, DataFrame]], edges: DataFrame) -> list[tuple[str, str]]:
    """(name, verdict) of contracts (name, kind, source, sink, guarantee), each of (id); a malformed kind is EMPTY.

    Both grades of all contracts make one search.
    """
    checkpointing(edges.sparkSession)
    verdicts, parts = {}, {"start": [], "sink": [], "removed": []}
    for name, kind, source, sink, guarantee in specs:
        if kind not in KINDS or sink.isEmpty() or kind != "cannot_reach" and guarantee.isEmpty() or kind == "crosses" and sink.join(guarantee, "id", "left_anti").isEmpty():
            verdicts[name] = "EMPTY"
            continue
        for sure in (True, False):
            case = F.lit(f"{name}/{'strong' if sure else 'all'}")
            parts["start"].append(source.select(case.alias("case"), F.lit(sure).alias("sure"), "id"))
            parts["sink"].append(sink.select(case.alias("case"), "id"))
            gone = removal(kind, guarantee.select(case.alias("case"), "id"), edges.where("strong") if sure else edges)
            parts["removed"].append(gone if gone is not None else sink.select(case.alias("case"), "id").limit(0))
    found = reaching(*(reduce(DataFrame.unionByName, parts[k]) for k in ("start", "sink")), edges, reduce(DataFrame.unionByName, parts["removed"])) if parts["start"] else []
    return [(name, verdicts.get(name) or ("BROKEN" if f"{name}/strong" in found else "SUSPECT" if f"{name}/all" in found else "PASS")) for name, *_ in specs]


def inverted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def within(source: DataFrame, sink: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """inside(id) of what is on some route from source(id) to sink(id), and source, sink and edges as far as they are on one.

    No route leaves it, so what is asked of routes is asked of it alone. The way back is searched in what was reached only.
    """
    checkpointing(edges.sparkSession)
    edges = edges.select("src", "dst").distinct()
    reached = graph.closure(source, edges).checkpoint()
    onward = edges.join(graph.apart(reached.withColumnRenamed("id", "src")), "src", "left_semi").checkpoint()
    on = graph.closure(sink.select("id").distinct().join(graph.apart(reached), "id", "left_semi"), inverted(onward)).checkpoint()
    kept = onward.join(graph.apart(on.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst").checkpoint()
    ends = [x.select("id").distinct().join(graph.apart(on), "id", "left_semi").checkpoint() for x in (source, sink)]
    return on, *ends, kept


def inside(source: DataFrame, sink: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) on some route from source(id) to sink(id)."""
    return within(source, sink, edges)[0]


def shortest(source: DataFrame, sink: DataFrame, edges: DataFrame) -> list:
    """the shortest path from source to sink, the least of equally near sinks first; empty if there is none."""
    reached = graph.depths(source, edges).checkpoint()
    near = reached.join(sink.select("id").distinct(), "id", "left_semi").orderBy("depth", "id").select("id").first()
    return graph.path(reached, near[0]) if near else []


def parted(start: DataFrame, goal: DataFrame, edges: DataFrame, gone: DataFrame, cases: int) -> set[int]:
    """The cases (0 to ``cases`` - 1) in which no goal(id) is reached from start(id) over edges(src, dst) without gone(case, id).

    A case ends with the first goal beside its frontier, which is looked for before anything of the round is kept.
    """
    key = ["case", "id"]
    edges, gone = graph.placed(edges), gone.select(*key).distinct().checkpoint()
    last = graph.placed(edges.join(graph.apart(goal.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst"))
    every = F.explode(F.sequence(F.lit(0), F.lit(cases - 1))).alias("case")
    level = start.select("id").distinct().select(every, "id").join(graph.apart(gone), key, "left_anti").checkpoint()
    seen, rounds, found = level, 0, {r[0] for r in level.join(graph.apart(goal), "id", "left_semi").select("case").distinct().collect()}
    step = lambda level, edges: level.join(graph.apart(edges), level["id"] == edges["src"]).select("case", F.col("dst").alias("id")).join(graph.apart(gone), key, "left_anti")
    while True:
        level = level.where(~F.col("case").isin(*found)) if found else level
        found |= {r[0] for r in step(level, last).select("case").distinct().collect()}
        level = step(level.where(~F.col("case").isin(*found)) if found else level, edges).distinct().join(graph.apart(seen), key, "left_anti").checkpoint()
        if level.isEmpty():
            return set(range(cases)) - found
        seen, rounds = seen.unionByName(level), rounds + 1
        if rounds % 16 == 0:
            seen = seen.checkpoint()


def cutting(source: DataFrame, sink: DataFrame, edges: DataFrame, tried: list[tuple], kind: str = "crosses") -> list:
    """Those of the nodes ``tried`` whose removal (for ``requires``, that of their callers too) parts source and sink.

    The search begins at the end of fewer nodes, as every case has all of them.
    """
    if not tried:
        return []
    spark, name = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    cases = spark.createDataFrame(list(enumerate(tried)), f"case int, id {name}")
    gone = removal(kind, cases, edges)
    ways = (source, sink, edges) if source.count() <= sink.count() else (sink, source, inverted(edges))
    cut = parted(*ways, gone, len(tried))
    return [x for i, x in enumerate(tried) if i in cut]


def chokepoints(source: DataFrame, sink: DataFrame, edges: DataFrame, path: list | None = None) -> list:
    """the nodes between source and sink without which no route is left; ``path`` is their shortest one, if it is known.

    Every route passes all of them, so the nodes of one shortest path are the only ones to try, however wide the routes are.
    """
    path = shortest(source, sink, edges) if path is None else path
    on = edges.sparkSession.createDataFrame([(x,) for x in path], f"id {edges.schema['src'].dataType.simpleString()}")
    ends = {r[0] for r in source.select("id").unionByName(sink.select("id")).distinct().join(on, "id", "left_semi").collect()}
    return cutting(source, sink, edges, [x for x in path if x not in ends])


def propose(source: DataFrame, sink: DataFrame, edges: DataFrame, mass: DataFrame, top: int = 10) -> list[tuple]:
    """(kind, id, mass) of what is worth a contract between source and sink, the heaviest first, ``top`` at most.

    Of the 12 * ``top`` heaviest nodes between them each is tried by removal, for ``crosses`` first. Whatever parts them lies on
    their shortest path, so for ``crosses`` only its nodes are searched; ``requires`` takes a node's callers away with it.
    """
    on, source, sink, edges = within(source, sink, edges)
    ends = source.unionByName(sink).distinct()
    ranked = on.join(graph.apart(ends), "id", "left_anti").join(graph.apart(mass), "id", "left").select("id", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    rows = ranked.orderBy(F.desc("mass"), "id").limit(12 * top).collect()
    path = set(shortest(source, sink, edges))
    crosses = set(cutting(source, sink, edges, [r[0] for r in rows if r[0] in path]))
    requires = set(cutting(source, sink, edges, [r[0] for r in rows if r[0] not in crosses], "requires"))
    found = [("crosses" if r[0] in crosses else "requires", r[0], r[1]) for r in rows if r[0] in crosses or r[0] in requires]
    return found[:top]
