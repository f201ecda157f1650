"""Closures, walks, paths and communities (of F1-F37, see README for what is absent) as loops over DataFrames.

Each round is checkpointed to the shared folder, so plans stay short and a lost executor costs a round at most. The driver
sees counts, never rows. A graph of at most ``SMALL`` edges and starts, which is counted first, is searched or walked by one
task instead, since a round costs more than such a graph; results are the same.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refgraph.session import checkpointing

ROUNDS = 200
SMALL = 1_000_000


def apart(frame: DataFrame) -> DataFrame:
    """This side of a join is sorted where it is, never collected by the driver to be broadcast: sides here grow with the graph."""
    return frame.hint("merge")


def placed(edges: DataFrame) -> DataFrame:
    """Edges kept by source and in order, so that the rounds of a search move only their newest nodes."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, "src").sortWithinPartitions("src").checkpoint()


def _small(*frames: DataFrame) -> bool:
    return all(f.limit(SMALL + 1).count() <= SMALL for f in frames)


def _searched(most: int | None):
    """Breadth-first search of one task: rows (src, dst) are edges, rows without dst are starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [b for b in batches if len(b)]
        if not every:
            return
        rows = pd.concat(every)
        begin = rows["start"].astype(bool).to_numpy()
        names = np.array(sorted(set(rows["src"]) | set(rows["dst"][~begin])), dtype=object)
        code = pd.Series(np.arange(len(names)), index=names)
        src, dst = code.loc[rows["src"][~begin]].to_numpy(), code.loc[rows["dst"][~begin]].to_numpy()
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        first = np.searchsorted(src, np.arange(len(names) + 1))
        depth, via = np.full(len(names), -1), np.full(len(names), -1)
        level = np.unique(code.loc[rows["src"][begin]].to_numpy()) if begin.any() else np.zeros(0, np.int64)
        depth[level] = 0
        for d in itertools.count(1) if most is None else range(1, most + 1):
            n = first[level + 1] - first[level]
            at = np.repeat(first[level] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = at[depth[dst[at]] < 0]
            level, where = np.unique(dst[at], return_index=True)  # the first is the least predecessor: levels ascend
            if not len(level):
                break
            depth[level], via[level] = d, src[at[where]]
        found = np.flatnonzero(depth >= 0)
        if not len(found):  # no start
            return
        yield pd.DataFrame({"id": names[found], "depth": depth[found].astype(np.int32), "via": [names[v] if v >= 0 else None for v in via[found]]})

    return run


def _walked(rounds: int, damping: float, tolerance: float):
    """The walk of one task: rows (src, dst, p) are transitions, rows (src, restart) nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches if len(b)])
        node = rows["restart"].notna().to_numpy()
        names = rows["src"][node].to_numpy()
        restart = rows["restart"][node].to_numpy(float)
        code = pd.Series(np.arange(len(names)), index=names)
        src, dst, p = code.loc[rows["src"][~node]].to_numpy(), code.loc[rows["dst"][~node]].to_numpy(), rows["p"][~node].to_numpy(float)
        ends = np.ones(len(names), bool)
        ends[src] = False
        mass = restart
        for _ in range(rounds):
            new = damping * np.bincount(dst, mass[src] * p, minlength=len(names)) + (1 - damping + damping * mass[ends].sum()) * restart
            moved, mass = np.abs(new - mass).sum(), new
            if tolerance and moved < tolerance:
                break
        yield pd.DataFrame({"id": names, "mass": mass})

    return run


def depths(start: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, depth, via) of everything reached from start(id) over edges(src, dst), in ``most`` steps if that is given;
    via is the least predecessor on a shortest path, null at depth 0. Level-synchronous: only the newest level meets the edges."""
    checkpointing(start.sparkSession)
    edges = placed(edges.select("src", "dst").distinct())
    kind = edges.schema["src"].dataType
    if _small(edges, start):
        rows = edges.select("src", "dst", F.lit(False).alias("start")).unionByName(start.select(F.col("id").cast(kind).alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(True).alias("start")))
        name = kind.simpleString()
        rows = rows.where("src is not null and (start or dst is not null)")
        return rows.coalesce(1).mapInPandas(_searched(most), f"id {name}, depth int, via {name}")
    level = start.select(F.col("id").cast(kind).alias("id")).distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("via")).checkpoint()
    seen, levels = level, [level]
    for depth in itertools.count(1) if most is None else range(1, most + 1):
        new = level.join(apart(edges), level["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        new = new.join(apart(seen.select("id")), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "via").checkpoint()
        if new.isEmpty():
            break
        levels.append(new)
        level = new
        seen = seen.unionByName(new)
        if len(levels) % 16 == 0:  # a long union is written once in a while, so that plans stay short
            seen = seen.checkpoint()
            levels = [seen]
    return seen


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of everything reached."""
    return depths(start, edges).select("id")


def fixpoint(start: DataFrame, edges: DataFrame, nested: DataFrame) -> DataFrame:
    """closure over references and containment together: whatever lies inside something reached is reached.

    nested(inner, outer). The least fixpoint of both is the closure over the union of both relations.
    """
    inside = nested.select(F.col("outer").alias("src"), F.col("inner").alias("dst"))
    return closure(start, edges.select("src", "dst").unionByName(inside))


def levels(symbols: DataFrame, roots: DataFrame, edges: DataFrame, nested: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """(id, level) with overlapping levels (T1). roots(id, product); edges(src, dst, strong).

    imported(file, dst, strong) is what modules refer to when they are imported: it is reached from the start; of the product
    only if its file holds a product root, and surely only over a strong reference. symbols(id, file).
    """
    every, product = roots.select("id"), roots.where("product").select("id")
    known = every
    if imported is not None:
        own = symbols.join(apart(product), "id", "left_semi").select("file").distinct()
        known = every.unionByName(imported.where("strong").select(F.col("dst").alias("id")))
        every = every.unionByName(imported.select(F.col("dst").alias("id")))
        product = product.unionByName(imported.join(own, "file", "left_semi").select(F.col("dst").alias("id")))
    reach, prod = fixpoint(every, edges, nested).checkpoint(), fixpoint(product, edges, nested).checkpoint()
    sure, plain = closure(known, edges.where("strong")).checkpoint(), closure(every, edges)
    parts = {
        "PRODUCT": prod.join(apart(sure), "id", "left_semi"),
        "PRODUCT_WEAK": prod.join(apart(sure), "id", "left_anti"),
        "NOT_PRODUCT": reach.join(apart(prod), "id", "left_anti"),
        "BY_NESTING": reach.join(apart(plain), "id", "left_anti"),
        "DEAD": symbols.select("id").join(apart(reach), "id", "left_anti"),
    }
    out = None
    for name, part in parts.items():
        part = part.select("id", F.lit(name).alias("level"))
        out = part if out is None else out.unionByName(part)
    return out


def transitions(weights: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, p), restricted to ``nodes`` first, without self-loops, each row summing to 1."""
    w = weights.where("src <> dst")
    if nodes is not None:
        n = nodes.select("id").distinct()
        w = w.join(apart(n.withColumnRenamed("id", "src")), "src", "left_semi").join(apart(n.withColumnRenamed("id", "dst")), "dst", "left_semi")
    w = w.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return w.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("p"))


def walk_mass(nodes: DataFrame, roots: DataFrame, weights: DataFrame, rounds: int = 60, damping: float = 0.85, tolerance: float = 1e-9, every: int = 5) -> DataFrame:
    """(id, mass) of the personalised walk. Roots inside ``nodes`` share the restart; without any, all nodes do.

    Dangling mass returns to the roots. With tolerance 0 exactly ``rounds`` rounds are made. Nodes, restart and mass stay
    hashed by id; a round is one join with the transitions and one aggregation.
    """
    checkpointing(nodes.sparkSession)
    p = transitions(weights, nodes).checkpoint()
    inside = roots.select("id").distinct().withColumn("root", F.lit(1.0))
    base = nodes.select("id").distinct().join(apart(inside), "id", "left")
    total, found = base.agg(F.count(F.lit(1)), F.count("root")).first()
    if not total:
        return base.select("id", F.lit(0.0).alias("mass"))
    restart = F.coalesce("root", F.lit(0.0)) / found if found else F.lit(1.0 / total)
    if total <= SMALL and _small(p):
        kind = p.schema["src"].dataType
        starts = base.select(F.col("id").cast(kind).alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("double").alias("p"), restart.cast("double").alias("restart"))
        rows = p.select("src", "dst", "p", F.lit(None).cast("double").alias("restart")).unionByName(starts)
        return rows.coalesce(1).mapInPandas(_walked(rounds, damping, tolerance), f"id {kind.simpleString()}, mass double")
    out = p.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True))
    base = base.join(apart(out), "id", "left").select("id", restart.alias("restart"), F.col("out").isNull().alias("dangling")).checkpoint()
    now = base.select("id", "restart", "dangling", F.col("restart").alias("mass"))
    for i in range(1, rounds + 1):
        lost = now.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("mass"))), F.lit(0.0)).alias("lost"))
        moved = now.join(apart(p), now["id"] == p["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("mass") * F.col("p")).alias("in"))
        new = now.join(apart(moved), "id", "left").crossJoin(F.broadcast(lost))  # one row
        new = new.select("id", "restart", "dangling", (damping * F.coalesce("in", F.lit(0.0)) + (1 - damping + damping * F.col("lost")) * F.col("restart")).alias("mass"), F.col("mass").alias("old"))
        if i % every == 0 or i == rounds:
            new = new.checkpoint()
            if tolerance and (new.agg(F.sum(F.abs(F.col("mass") - F.col("old")))).first()[0] or 0) < tolerance:
                now = new
                break
        now = new.drop("old")
    return now.select("id", "mass")


def visits(start: DataFrame, p: DataFrame, rounds: int = 200, damping: float = 0.85, tolerance: float = 1e-9, every: int = 5) -> DataFrame:
    """(id, visits) expected in the absorbing chain: 1 at each start, plus every front that follows."""
    checkpointing(start.sparkSession)
    p = p.checkpoint()
    front = start.select("id").distinct().withColumn("v", F.lit(1.0))
    total = front.select("id", F.col("v").alias("visits"))
    for i in range(1, rounds + 1):
        front = front.join(apart(p), front["id"] == p["src"]).groupBy(F.col("dst").alias("id")).agg((damping * F.sum(F.col("v") * F.col("p"))).alias("v"))
        if i % every == 0 or i == rounds:
            front = front.checkpoint()
            if tolerance and (front.agg(F.sum("v")).first()[0] or 0) < tolerance:
                break
        total = total.unionByName(front.select("id", F.col("v").alias("visits"))).groupBy("id").agg(F.sum("visits").alias("visits"))
        if i % every == 0:
            total = total.checkpoint()
    return total


def decisions(p: DataFrame, seen: DataFrame, most: float = 0.98) -> DataFrame:
    """F8: (id, branches, largest, weight) of nodes with two branches or more, none of ``most``."""
    each = p.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("branches"), F.max("p").alias("largest")).where((F.col("branches") >= 2) & (F.col("largest") < most))
    return each.join(seen, "id").select("id", "branches", "largest", (F.col("visits") * (1 - F.col("largest"))).alias("weight"))


def forks(calls: DataFrame) -> DataFrame:
    """(src, cond, branches, targets) where one caller calls in two branches of a condition or more."""
    return calls.groupBy("src", "cond").agg(F.count_distinct("branch").alias("branches"), F.array_sort(F.collect_set("dst")).alias("targets")).where("branches >= 2")


def forks_at_runtime(calls: DataFrame, observed: DataFrame) -> DataFrame:
    """(src, cond, runtime, happen): what of a fork's branches is compatible with what was seen; calls(src, cond, branch, dst),
    observed(id). A branch counts as seen if one of its targets is; never more is said than "compatible", as another caller may
    have run it."""
    seen = observed.select(F.col("id").alias("dst")).distinct().withColumn("seen", F.lit(True))
    each = calls.join(apart(seen), "dst", "left").groupBy("src", "cond").agg(F.array_sort(F.collect_set("branch")).alias("every"), F.array_sort(F.collect_set(F.when(F.col("seen"), F.col("branch")))).alias("happen"))
    both = each.where(F.size("every") >= 2).withColumn("rest", F.array_except("every", "happen"))
    n = F.size("happen")
    said = F.when(F.size("rest") == 0, "every branch happens").when(n == 1, F.concat(F.lit("compatible with "), F.get("happen", F.lit(0)))).when(n == 0, "no branch observed").otherwise("some happen")
    return both.select("src", "cond", said.alias("runtime"), "happen")


def hubs(weights: DataFrame, share: float = 0.01) -> DataFrame:
    """(id, degree, hub): weighted degree over both ends; the top ``share`` (one at least) are hubs.

    The cut is the degree of the last hub, found by ordering the degrees' counts, so no window spans all nodes.
    """
    degree = weights.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("degree")).checkpoint()
    n = degree.count()
    top = degree.orderBy(F.desc("degree"), "id").limit(max(1, int(n * share))).select("id", F.lit(True).alias("hub"))
    return degree.join(top, "id", "left").select("id", "degree", F.coalesce("hub", F.lit(False)).alias("hub"))


def symmetric(weights: DataFrame) -> DataFrame:
    """(src, dst, w) with both directions summed, no self-loops."""
    w = weights.where("src <> dst")
    return w.select("src", "dst", "w").unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def cells(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, w): weights in both directions between groups, and twice those inside each, no self-loops.

    Weights are summed by groups before directions are, so nothing is sorted or kept by pairs of nodes; they may come unsummed.
    """
    checkpointing(weights.sparkSession)
    g = groups.select("id", "grp")
    one = weights.where("src <> dst").join(apart(g.select(F.col("id").alias("src"), F.col("grp").alias("a"))), "src").join(apart(g.select(F.col("id").alias("dst"), F.col("grp").alias("b"))), "dst").groupBy("a", "b").agg(F.sum("w").alias("w")).checkpoint()
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, inside, degree, q) for groups of two or more; the modularity is the sum of q."""
    a = cells(weights, groups)
    cell = a.groupBy(F.col("a").alias("grp")).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree"))
    m2 = a.agg(F.sum("w").alias("m2"))
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    return cell.join(sizes, "grp").crossJoin(F.broadcast(m2)).select("grp", "inside", "degree", (F.col("inside") / F.col("m2") - (F.col("degree") / F.col("m2")) ** 2).alias("q"))  # m2 is one row


def cohesion(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, cohesion): which part of a group's references, in both directions, stays inside it."""
    a = symmetric(weights).join(groups.select(F.col("id").alias("src"), F.col("grp").alias("a")), "src").join(groups.select(F.col("id").alias("dst"), F.col("grp").alias("b")), "dst")
    return a.groupBy(F.col("a").alias("grp")).agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("cohesion"))


def merge_gain(weights: DataFrame, groups: DataFrame, least: int = 15) -> DataFrame:
    """F16: (a, b, gain) for connected pairs of groups of ``least`` members or more, a < b."""
    w = cells(weights, groups)
    m2 = w.agg(F.sum("w").alias("m2"))
    large = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("grp")
    degree = w.groupBy(F.col("a").alias("grp")).agg(F.sum("w").alias("k")).join(large, "grp")
    between = w.where("a < b").select("a", "b", F.col("w").alias("between"))
    ka, kb = degree.select(F.col("grp").alias("a"), F.col("k").alias("ka")), degree.select(F.col("grp").alias("b"), F.col("k").alias("kb"))
    both = between.join(ka, "a").join(kb, "b").crossJoin(F.broadcast(m2))
    return both.select("a", "b", (2 * F.col("between") / F.col("m2") - 2 * F.col("ka") * F.col("kb") / F.col("m2") ** 2).alias("gain"))


def islands(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, file, island): components of the undirected edges inside each file, named by their least id.

    Every node takes the least name around it and then its name's name, so long chains halve each round.
    """
    checkpointing(nodes.sparkSession)
    f = nodes.select("id", "file")
    inner = edges.select("src", "dst").where("src <> dst").join(f.withColumnRenamed("id", "src"), "src").join(f.select(F.col("id").alias("dst"), F.col("file").alias("other")), "dst").where("file = other")
    pairs = inner.select("src", "dst").unionByName(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    name = f.select("id", F.col("id").alias("island")).checkpoint()
    for _ in range(ROUNDS):
        near = pairs.join(name.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("island").alias("near"))
        new = name.join(near, "id", "left").select("id", F.least("island", "near").alias("island"), F.col("island").alias("old"))
        jump = new.select(F.col("id").alias("island"), F.col("island").alias("next"))
        new = new.join(jump, "island").select("id", F.least("island", "next").alias("island"), "old").checkpoint()
        changed = not new.where("island <> old").isEmpty()
        name = new.select("id", "island")
        if not changed:
            break
    return name.join(f, "id").select("id", "file", "island")


def island_verdicts(labels: DataFrame, cohesive: DataFrame, least: int = 10) -> DataFrame:
    """(file, symbols, cohesion, largest, islands, verdict) of files of ``least`` symbols or more; labels(id, file, island),
    cohesive(grp, cohesion). A dominant island wins over low cohesion."""
    sized = labels.groupBy("file", "island").agg(F.count(F.lit(1)).alias("n"))
    x = sized.groupBy("file").agg(F.sum("n").alias("symbols"), (F.max("n") / F.sum("n")).alias("largest"), F.count_if(F.col("n") >= 2).alias("islands")).where(F.col("symbols") >= least)
    x = x.join(cohesive.withColumnRenamed("grp", "file"), "file", "left").withColumn("cohesion", F.coalesce("cohesion", F.lit(0.0)))
    said = F.when(F.col("largest") >= 0.6, "one big thing").when(F.col("cohesion") < 0.15, "not cohesive").when(F.col("islands") >= 3, "split along the islands").otherwise("no clear signal")
    return x.select("file", "symbols", "cohesion", "largest", "islands", said.alias("verdict"))


def swept(weights: DataFrame, groups: DataFrame, inflations: tuple[float, ...], least: int = 5, rounds: int = 24, top: int | None = 40) -> DataFrame:
    """(inflation, k, q): for each inflation the clusters of ``least`` members or more and the modularity of all; inflation
    null: the declared groups(id, grp). All are scored on the graph without hubs, which is the one that was clustered."""
    checkpointing(weights.sparkSession)
    hub = hubs(weights).where("hub").select("id")
    w = weights.join(hub.withColumnRenamed("id", "src"), "src", "left_anti").join(hub.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "w").checkpoint()
    nodes = groups.select("id").distinct().join(hub, "id", "left_anti").checkpoint()
    tried = [(None, groups.join(hub, "id", "left_anti").select("id", "grp"))]
    tried += [(r, mcl(w, nodes, r, rounds, top=top).select("id", F.col("cluster").alias("grp"))) for r in inflations]
    out = None
    for r, found in tried:
        found = found.checkpoint()
        k = found.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") >= (1 if r is None else least)).alias("k"))
        row = k.crossJoin(modularity(w, found).agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("q"))).select(F.lit(r).cast("double").alias("inflation"), "k", "q")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def submodules(weights: DataFrame, groups: DataFrame, inflations: tuple[float, ...] = (1.2, 1.4, 1.7, 2.0), symbols: int = 25, least: int = 4, rounds: int = 20) -> DataFrame:
    """(module, symbols, cohesion, q, k, inflation): each module's best partition, scored inside it alone.

    Modules share no edges once those between them are left out, so one clustering serves all of them at once and none
    comes to one task. Modules of fewer than ``symbols`` are left out; one without a partition of positive q is one part.
    """
    checkpointing(weights.sparkSession)
    g = groups.select("id", "grp").distinct().checkpoint()
    big = g.groupBy(F.col("grp").alias("module")).agg(F.count(F.lit(1)).alias("symbols")).where(F.col("symbols") >= symbols)
    inner = weights.join(g.select(F.col("id").alias("src"), F.col("grp").alias("module")), "src").join(g.select(F.col("id").alias("dst"), F.col("grp").alias("other")), "dst").where("module = other")
    inner = inner.join(big.select("module"), "module", "left_semi").select("src", "dst", "w").checkpoint()
    own = g.select("id", F.col("grp").alias("module"))
    nodes = own.join(big, "module", "left_semi").select("id").checkpoint()
    a = symmetric(inner).join(own.withColumnRenamed("id", "src"), "src").checkpoint()
    m2 = a.groupBy("module").agg(F.sum("w").alias("m2"))
    out = None
    for r in inflations:
        found = mcl(inner, nodes, r, rounds, top=None).checkpoint()
        c = a.join(found.select(F.col("id").alias("src"), F.col("cluster").alias("ca")), "src").join(found.select(F.col("id").alias("dst"), F.col("cluster").alias("cb")), "dst")
        cell = c.groupBy("module", F.col("ca").alias("cluster")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree"))
        size = found.join(own, "id").groupBy("module", "cluster").agg(F.count(F.lit(1)).alias("n"))
        q = cell.join(size, ["module", "cluster"], "right").join(m2, "module").withColumn("q", F.when(F.col("n") >= 2, F.coalesce("inside", F.lit(0.0)) / F.col("m2") - (F.coalesce("degree", F.lit(0.0)) / F.col("m2")) ** 2).otherwise(0.0))
        q = q.groupBy("module").agg(F.sum("q").alias("q"), F.count_if(F.col("n") >= least).alias("k")).select("module", "q", "k", F.lit(r).alias("inflation"))
        out = q if out is None else out.unionByName(q)
    best = out.where("q > 0").groupBy("module").agg(F.max_by(F.struct("q", "k", "inflation"), F.struct("q", -F.col("inflation"))).alias("x"))
    every = big.join(m2.select("module"), "module", "left_semi").join(cohesion(weights, g).withColumnRenamed("grp", "module"), "module", "left").join(best, "module", "left")
    return every.select("module", "symbols", "cohesion", F.coalesce("x.q", F.lit(0.0)).alias("q"), F.coalesce("x.k", F.lit(1)).alias("k"), F.col("x.inflation").alias("inflation"))


def mcl(weights: DataFrame, nodes: DataFrame, inflation: float = 2.0, rounds: int = 24, prune: float = 1e-5, top: int | None = 40) -> DataFrame:
    """(id, cluster) by Markov clustering; cluster is the least row index of the greatest value of a column.

    Sparse matrices are (i, j, v) rows; squaring is a join on the inner index and an aggregation, pruned each round.
    """
    checkpointing(nodes.sparkSession)
    a = symmetric(weights).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))
    loop = nodes.select(F.col("id").alias("i")).join(a.groupBy("i").agg(F.max("v").alias("m")), "i", "left").select("i", F.col("i").alias("j"), F.coalesce("m", F.lit(1.0)).alias("v"))
    column = Window.partitionBy("j")
    m = a.unionByName(loop).select("i", "j", (F.col("v") / F.sum("v").over(column)).alias("v")).checkpoint()
    for k in range(rounds):
        left, right = m.select("i", F.col("j").alias("k"), F.col("v").alias("x")), m.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
        sq = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
        sq = sq.select("i", "j", F.pow("v", F.lit(inflation)).alias("v")).where(F.col("v") >= prune)
        if top:
            sq = sq.withColumn("k", F.rank().over(column.orderBy(F.desc("v")))).where(F.col("k") <= top).drop("k")
        m = sq.select("i", "j", (F.col("v") / F.sum("v").over(column)).alias("v"))
        if k % 2 or k == rounds - 1:
            m = m.checkpoint()
    return m.groupBy(F.col("j").alias("id")).agg(F.max_by("i", F.struct(F.round("v", 6), -F.col("i"))).alias("cluster"))


def path(reached: DataFrame, target: int | str) -> list:
    """the shortest path to ``target`` that ``depths`` knows, from its start; empty if it wasn't reached.

    By pointer jumping: each round joins what is known of the path with pointers twice as long, so a path of n steps takes
    log n rounds, and only it comes to the driver.
    """
    checkpointing(reached.sparkSession)
    row = reached.where(F.col("id") == target).select("depth").first()
    if row is None:
        return []
    on, up = reached.where(F.col("id") == target).select("id"), reached.where("via is not null").select("id", "via")
    for _ in range(row[0].bit_length()):
        up = up.checkpoint()
        on = on.unionByName(on.join(up, "id").select(F.col("via").alias("id"))).checkpoint()
        up = up.join(up.select(F.col("id").alias("via"), F.col("via").alias("next")), "via").select("id", F.col("next").alias("via"))
    return [r[0] for r in reached.join(on, "id", "left_semi").orderBy("depth").select("id").collect()]


def services(entry: DataFrame, files: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(service, file): what an entry file reaches, where reaching a file also reaches the roots that it holds.

    entry(service, file); files(id, file); roots(id). Services go together: nodes are (service, id) pairs.
    """
    checkpointing(entry.sparkSession)
    in_file = roots.select("id").distinct().join(files, "id").select(F.col("id").alias("root"), "file").checkpoint()
    level = entry.join(files, "file").select("service", "id").distinct().checkpoint()
    seen = level
    for done in itertools.count(1):
        by_call = level.join(edges, level["id"] == edges["src"]).select("service", F.col("dst").alias("id"))
        by_file = level.join(files, "id").select("service", "file").distinct().join(in_file, "file").select("service", F.col("root").alias("id"))
        level = by_call.unionByName(by_file).distinct().join(seen, ["service", "id"], "left_anti").checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if done % 16 == 0:  # as in depths
            seen = seen.checkpoint()
    return seen.join(files, "id").select("service", "file").distinct()


def told(start: DataFrame, calls: DataFrame, top: int = 8, depth: int = 4, inside: DataFrame | None = None) -> DataFrame:
    """(path, depth, ordinal, id, repeats, pruned): the tree of what each start(id) calls, ``depth`` levels deep.

    calls(src, dst, w, place). Of a node's successors the ``top`` heaviest are told in order of place, and the rest is counted
    in ``pruned``; with inside(id), those on the route are told, all of them. One that stands on its own path repeats and isn't
    expanded. ``path`` ends with the node itself.
    """
    checkpointing(start.sparkSession)
    each = calls.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"), F.min("place").alias("place"))
    by, out = Window.partitionBy("src"), F.count(F.lit(1)).over(Window.partitionBy("src"))
    each = each.withColumn("n", out)
    if inside is None:
        each = each.withColumn("k", F.row_number().over(by.orderBy(F.desc("w"), "dst"))).where(F.col("k") <= top).withColumn("pruned", F.col("n") - F.count(F.lit(1)).over(by))
    else:
        each = each.join(inside.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").withColumn("pruned", F.lit(0).cast("long"))
    each = each.select("src", "dst", F.row_number().over(by.orderBy("place", "dst")).alias("ordinal"), "pruned").checkpoint()
    cut = each.groupBy("src").agg(F.first("pruned").alias("pruned"))
    level = start.select("id").distinct().select(F.array("id").alias("path"), F.lit(0).alias("depth"), F.lit(1).alias("ordinal"), "id", F.lit(False).alias("repeats")).checkpoint()
    tree = level
    for d in range(1, depth + 1):
        level = level.where("not repeats").select("path", "id").join(each, F.col("id") == F.col("src"))
        level = level.select(F.concat("path", F.array("dst")).alias("path"), F.lit(d).alias("depth"), "ordinal", F.col("dst").alias("id"), F.expr("array_contains(path, dst)").alias("repeats")).checkpoint()
        tree = tree.unionByName(level)
    expanded = (F.col("depth") < depth) & ~F.col("repeats")
    return tree.join(cut, tree["id"] == cut["src"], "left").select("path", "depth", "ordinal", "id", "repeats", F.when(expanded, F.coalesce("pruned", F.lit(0))).otherwise(0).cast("long").alias("pruned"))


def condensed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, head, steps): the chain each node belongs to, named by its first node, and the chain's length.

    nodes(id, lane); edges(src, dst). An edge is cut where its target has other callers, its source other calls, or the lane
    changes; names run down the uncut edges by pointer jumping. Nodes of pure cycles stay single.
    """
    checkpointing(nodes.sparkSession)
    e = edges.where("src <> dst").select("src", "dst").distinct()
    e = e.withColumn("o", F.count(F.lit(1)).over(Window.partitionBy("src"))).withColumn("i", F.count(F.lit(1)).over(Window.partitionBy("dst"))).where("o = 1 and i = 1")
    lane = nodes.select("id", "lane")
    e = e.join(lane.select(F.col("id").alias("src"), F.col("lane").alias("la")), "src").join(lane.select(F.col("id").alias("dst"), F.col("lane").alias("lb")), "dst").where("la <=> lb")
    up = nodes.select("id").join(e.select(F.col("dst").alias("id"), F.col("src").alias("up")), "id", "left").select("id", F.coalesce("up", "id").alias("up")).checkpoint()
    for _ in range(40):
        jump = up.select(F.col("id").alias("up"), F.col("up").alias("next"))
        new = up.join(jump, "up").select("id", F.col("next").alias("up"), F.col("up").alias("old")).checkpoint()
        done = new.where("up <> old").isEmpty()
        up = new.select("id", "up")
        if done:
            break
    ends = up.where("id = up").select(F.col("id").alias("up"), F.lit(True).alias("end"))  # a cycle has no end
    named = up.join(ends, "up", "left").select("id", F.when(F.col("end"), F.col("up")).otherwise(F.col("id")).alias("head"))
    return named.withColumn("steps", F.count(F.lit(1)).over(Window.partitionBy("head")))
