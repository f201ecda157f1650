"""Queries of closures, walks, contracts, paths and chains over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refgraph.operators import graph, joins, routes
from refgraph.plans import bindings as b
from refgraph.plans.registry import Tables, query
from refgraph.session import checkpointing



def _reach(name: str, start: str, edges: str) -> str:
    return f"{name}(id) as (select id from {start} union select e.dst from {name} join {edges} e on e.src = {name}.id)"


def _bfs(name: str, start: str, edges: str) -> str:
    return f"{name}(id, depth) using key (id) as (select id, 0 from {start} union select e.dst, min(x.depth) + 1 from {name} x join {edges} e on e.src = x.id where not exists (select 1 from recurring.{name} k where k.id = e.dst) group by e.dst)"


@query(f"with recursive {b.RETURNED}, {b.ROOTS}, {_reach('r', 'roots', 'edges')} select id from r")
def closure_forward(t: Tables):
    """F1."""
    return graph.closure(b.roots(t), b.returned(t))


@query(f"with recursive {b.RETURNED}, {b.ROOTS}, s as (select src, dst from edges where strong), {_bfs('d', 'roots', 's')} select id, depth::INT as depth from d")
def depth_from_roots(t: Tables):
    """least depth over strong edges."""
    return graph.depths(b.roots(t), b.returned(t).where("strong")).select("id", "depth")


def _nested(t: Tables) -> DataFrame:
    return joins.nested(b.parts(t), 50)


_NESTED = "nested as (select i.id as inner_id, o.id as outer_id from parts i join parts o on i.file = o.file and i.line > o.line and i.\"end\" <= o.\"end\")"
_LEVELS = f"""{b.RETURNED}, {b.PARTS}, {b.ROOTS}, {_NESTED}, proot as (select id from roots where product), s as (select src, dst from edges where strong),
both as (select src, dst from edges union all select outer_id, inner_id from nested)""".replace("both as", "joint as")
_RISKS = f"{_LEVELS}, {_reach('reach', 'roots', 'joint')}"
_LEVELS += f""", {b.IMPORTED}, every as (select id from roots union all select dst from imported), known as (select id from roots union all select dst from imported where strong),
pseed as (select id from proot union all select dst from imported where file in (select file from parts where id in (from proot))),
{_reach('reach', 'every', 'joint')}, {_reach('prod', 'pseed', 'joint')}, {_reach('sure', 'known', 's')}, {_reach('plain', 'every', 'edges')}"""


@query(f"""with recursive {_LEVELS}
select id, 'PRODUCT' as level from prod where id in (from sure) union all select id, 'PRODUCT_WEAK' from prod where id not in (from sure)
union all select id, 'NOT_PRODUCT' from reach where id not in (from prod) union all select id, 'BY_NESTING' from reach where id not in (from plain)
union all select id, 'DEAD' from parts where id not in (from reach)""")
def liveness_levels(t: Tables):
    """With what modules refer to on import."""
    checkpointing(t.spark)
    return graph.levels(b.parts(t), b.roots(t), b.returned(t).checkpoint(), _nested(t).checkpoint(), b.imported(t))


_WALK = b.chained(
    "select id, restart as m from base",
    "select base.id, 0.85 * coalesce(x.s, 0) + (0.15 + 0.85 * (select coalesce(sum(m), 0) from {r} join base using (id) where dangling)) * restart as m from base left join (select dst as id, sum(m * p) as s from {r} join p on src = id group by dst) x using (id)",
    20,
)
_MASS = f"""{b.RETURNED}, {b.PARTS}, {b.ROOTS}, {b.TRANSITIONS}, proot as (select id from roots where product),
base as materialized (select parts.id, case when proot.id is null then 0 else 1 / (select count(*) from proot) end as restart, parts.id not in (select src from p) as dangling from parts left join proot using (id)), {_WALK}, mass as (select id, m from r20)"""


def _mass(t: Tables) -> DataFrame:
    return graph.walk_mass(b.parts(t), b.roots(t).where("product"), b.returned(t), rounds=20, tolerance=0.0)


@query(f"with {_MASS} select id, round(m, 7) as mass from mass")
def pagerank_personalised(t: Tables):
    """20 rounds."""
    return _mass(t).select("id", F.round("mass", 7).alias("mass"))


def _rolled(t: Tables, group: str) -> DataFrame:
    each = _mass(t).join(b.parts(t), "id").groupBy(group)
    return each.agg(F.round(F.sum("mass"), 6).alias("mass"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("mass") <= 1e-12).alias("cold"))


@query(f"with {_MASS} select file, round(sum(m), 6) as mass, count(*) as members, count(*) filter (m <= 1e-12) as cold from mass join parts using (id) group by file")
def mass_by_file(t: Tables):
    """E2."""
    return _rolled(t, "file")


@query(f"with {_MASS} select module, round(sum(m), 6) as mass, count(*) as members, count(*) filter (m <= 1e-12) as cold from mass join parts using (id) group by module")
def mass_by_module(t: Tables):
    """E3."""
    return _rolled(t, "module")


@query(f"""with recursive {_RISKS}, {b.TRANSITIONS}, base as materialized (select parts.id, case when proot.id is null then 0 else 1 / (select count(*) from proot) end as restart, parts.id not in (select src from p) as dangling from parts left join proot using (id)),
{_WALK}, m as (select id, m from r20), alive as (select parts.*, m, parts.id in (from reach) as live from parts join m using (id)),
f as (select file, sum(case when live then m else 0 end) as around, avg(case when live then 0 else 1 end) as dead from alive group by file),
o as (select src as id, sum(m) as out from edges join m on m.id = dst where src <> dst group by src),
c as (select alive.id, around, dead, coalesce(out, 0) as out from alive join f using (file) left join o using (id) where not live),
n as (select *, max(around) over () as ma, max(out) over () as mo from c)
select id, round(0.5 * coalesce(around / nullif(ma, 0), 0) * (1 - dead) + 0.5 * coalesce(out / nullif(mo, 0), 0), 4) as risk from n""")
def deletion_risk(t: Tables):
    """Risk of deleting each dead part."""
    checkpointing(t.spark)
    edges, parts = b.returned(t).checkpoint(), b.parts(t)
    mass = graph.walk_mass(parts, b.roots(t).where("product"), edges, rounds=20, tolerance=0.0).checkpoint()
    live = graph.fixpoint(b.roots(t), edges, _nested(t)).withColumn("live", F.lit(True))
    alive = parts.join(mass, "id").join(live, "id", "left").select("id", "file", "mass", F.coalesce("live", F.lit(False)).alias("live")).checkpoint()
    around = alive.groupBy("file").agg(F.sum(F.when(F.col("live"), F.col("mass")).otherwise(0.0)).alias("around"), F.avg(F.when(F.col("live"), 0.0).otherwise(1.0)).alias("dead"))
    out = edges.join(mass.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("mass").alias("out"))
    c = alive.where("not live").join(around, "file").join(out, "id", "left").select("id", "around", "dead", F.coalesce("out", F.lit(0.0)).alias("out"))
    top = c.agg(F.max("around").alias("ma"), F.max("out").alias("mo"))
    share = lambda x, m: F.coalesce(F.try_divide(F.col(x), F.col(m)), F.lit(0.0))
    return c.crossJoin(F.broadcast(top)).select("id", F.round(0.5 * share("around", "ma") * (1 - F.col("dead")) + 0.5 * share("out", "mo"), 4).alias("risk"))  # top is one row


_VISITS = b.chained("select 'signup' as id, 1.0::DOUBLE as v", "select dst as id, 0.85 * sum(v * p) as v from {r} join p on src = id group by dst", 20)
_SEEN = f"{b.JOURNEYS}, {b.TRANSITIONS}, {_VISITS}, seen as (select id, sum(v) as visits from ({' union all '.join(f'from r{k}' for k in range(21))}) group by id)"


def _visits(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = graph.transitions(b.journeys(t))
    start = t["events"].where("event_type = 'signup'").select(F.col("event_type").alias("id")).distinct()
    return p, graph.visits(start, p, rounds=20, tolerance=0.0)


@query(f"with {_SEEN} select id, round(visits, 6) as visits from seen")
def expected_visits(t: Tables):
    """20 fronts from signup."""
    return _visits(t)[1].select("id", F.round("visits", 6).alias("visits"))


@query(f"""with {_SEEN}, d as (select src as id, count(*) as branches, max(p) as largest from p group by src having count(*) >= 2 and max(p) < 0.98)
select id, branches, round(largest, 6) as largest, round(visits * (1 - largest), 6) as weight from d join seen using (id)""")
def decision_nodes(t: Tables):
    """F8."""
    p, seen = _visits(t)
    return graph.decisions(p, seen).select("id", "branches", F.round("largest", 6).alias("largest"), F.round("weight", 6).alias("weight"))


@query(f"""with recursive {b.RETURNED}, {b.PARTS}, inner_edges as (select src, dst from edges join parts s on s.id = src join parts d on d.id = dst where s.file = d.file),
sym as (select src, dst from inner_edges union select dst, src from inner_edges),
r(root, id) as (select id, id from parts union select root, dst from r join sym on src = r.id),
labelled as (select id, min(root) as island from r group by id)
select id, file, island from labelled join parts using (id)""")
def islands_components(t: Tables):
    """Components inside each file."""
    return graph.islands(b.returned(t), b.parts(t))


@query()
def mcl_clusters(t: Tables):
    """clusters of event types, 8 rounds; floats of 1e-5 decide, so tests hold it against a dense version."""
    names = t["events"].select("event_type").distinct().withColumn("id", F.dense_rank().over(Window.orderBy("event_type")))  # a handful of types
    w = b.journeys(t).join(names.select(F.col("event_type").alias("src"), F.col("id").alias("a")), "src").join(names.select(F.col("event_type").alias("dst"), F.col("id").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    found = graph.mcl(w, names, rounds=8)
    return names.join(found, "id").select("event_type", "cluster")


def _trade(t: Tables) -> DataFrame:
    """(src, dst, strong): customer -> part -> supplier, as strings with a letter; strong if a line has 25 pieces or more."""
    lines = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    sure = F.col("l_quantity") >= 25
    c, p, s = (F.concat(F.lit(x), F.col(y).cast("string")) for x, y in (("c", "o_custkey"), ("p", "l_partkey"), ("s", "l_suppkey")))
    e = lines.select(c.alias("src"), p.alias("dst"), sure.alias("strong")).unionByName(lines.select(p.alias("src"), s.alias("dst"), sure.alias("strong")))
    return e.groupBy("src", "dst").agg(F.bool_or("strong").alias("strong"))


_TRADE = """lines as (select * from lineitem join orders on o_orderkey = l_orderkey),
edges as (select src, dst, bool_or(q >= 25) as strong from (select 'c' || o_custkey as src, 'p' || l_partkey as dst, l_quantity as q from lines union all select 'p' || l_partkey, 's' || l_suppkey, l_quantity from lines) group by src, dst)"""


@query(f"""with recursive {_TRADE}, s as (select src, dst from edges where strong and dst not in (select 'p' || p_partkey from part where p_type = 'PROMO')), start as (select 'c0' as id), {_bfs('d', 'start', 's')},
via as (select e.dst as id, min(e.src) as via from s e join d a on a.id = e.src join d x on x.id = e.dst where x.depth = a.depth + 1 group by e.dst)
select id, depth::INT as depth, via.via from d left join via using (id)""")
def shortest_path_avoiding(t: Tables):
    """everything that customer 0 reaches without passing a part in promotion, with the least predecessor of each."""
    barred = t["part"].where("p_type = 'PROMO'").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("dst"))
    start = t.spark.range(1).select(F.lit("c0").alias("id"))
    return graph.depths(start, _trade(t).where("strong").join(barred, "dst", "left_anti"))


_SPECS = [("all_parts_guard", "crosses", "part", "true"), ("promo_guard", "crosses", "part", "p_type = 'PROMO'"), ("promo_required", "requires", "part", "p_type = 'PROMO'"), ("never", "cannot_reach", "part", "false"), ("no_guard", "crosses", "part", "false"), ("malformed", "crossing", "part", "true")]


def _contract_sql(name: str, kind: str, where: str) -> str:
    """Three layers without cycles: a path is one customer edge followed by one supplier edge."""
    guard = f"select 'p' || p_partkey from part where {where}"
    gone = guard if kind == "crosses" else f"{guard} union select src from edges where dst in ({guard})" if kind == "requires" else "select null where false"
    bad = f"select count(*) from edges a join edges b on b.src = a.dst where a.src in (from src) and b.dst in (from sink) and a.src not in ({gone}) and a.dst not in ({gone}) and b.dst not in ({gone})"
    # The strong grade takes callers of the guarantee over strong edges alone.
    strong = bad.replace("from edges", "from sedges").replace("join edges", "join sedges")
    empty = "false" if kind == "cannot_reach" else f"(select count(*) from ({guard})) = 0" if kind in routes.KINDS else "true"
    return f"select '{name}' as name, case when {empty} then 'EMPTY' when ({strong}) > 0 then 'BROKEN' when ({bad}) > 0 then 'SUSPECT' else 'PASS' end as verdict"


_CONTRACTS = f"""with {_TRADE}, sedges as (select * from edges where strong), src as (select 'c' || c_custkey as id from customer where c_mktsegment = 'BUILDING'), sink as (select 's' || s_suppkey as id from supplier where s_nationkey < 5)
{" union all ".join(_contract_sql(n, k, w) for n, k, _, w in _SPECS)}"""


def _verdicts(t: Tables, source: DataFrame, sink: DataFrame, edges: DataFrame) -> list[tuple[str, str]]:
    guard = lambda where: t["part"].where(where).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return routes.verify([(name, kind, source, sink, guard(where)) for name, kind, _, where in _SPECS], edges)


@query(_CONTRACTS)
def contracts_verify(t: Tables):
    """Declared contracts between customers of a segment and suppliers of five nations; a malformed one is EMPTY.

    All of them, at both grades, are one distributed search, and only the verdicts come to the driver.
    """
    checkpointing(t.spark)
    edges = _trade(t).checkpoint()
    source = t["customer"].where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    sink = t["supplier"].where("s_nationkey < 5").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return t.spark.createDataFrame(_verdicts(t, source, sink, edges), "name string, verdict string")


@query(f"select verdict, count(*) as contracts from ({_CONTRACTS}) group by verdict")
def contract_counts(t: Tables):
    """How many contracts have each verdict."""
    return contracts_verify(t).groupBy("verdict").agg(F.count(F.lit(1)).alias("contracts"))


_ROUTE = f"""{b.RETURNED}, {b.PARTS}, s as (select src, dst from edges where strong), flipped as (select dst as src, src as dst from s),
a as (select id from parts where module = 'PROMO'), z as (select id from parts where module = 'LARGE'), {_reach('fwd', 'a', 's')}, {_reach('bwd', 'z', 'flipped')}"""


def _ends(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, s = b.parts(t), b.returned(t).where("strong")
    return p.where("module = 'PROMO'").select("id"), p.where("module = 'LARGE'").select("id"), s


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@query(f"with recursive {_ROUTE} select id, id in (from a) as source, id in (from z) as sink from fwd where id in (from bwd)")
def route_dag(t: Tables):
    """What lies on some route from parts in promotion to large ones."""
    a, z, s = _ends(t)
    inside = graph.closure(a, s).join(graph.closure(z, _flip(s)), "id", "left_semi")
    return inside.join(a.withColumn("source", F.lit(True)), "id", "left").join(z.withColumn("sink", F.lit(True)), "id", "left").select("id", F.coalesce("source", F.lit(False)).alias("source"), F.coalesce("sink", F.lit(False)).alias("sink"))


_GEO = """s as materialized (select distinct src, dst from (
  select 'o' || o_orderkey as src, 'c' || o_custkey as dst from orders union all select 'o' || o_orderkey, 'n' || c_nationkey from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT'
  union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
  union all select 'n' || n_nationkey, 'k' || n_nationkey from nation union all select 'k' || n_nationkey, 'r' || n_regionkey from nation))"""
_SINGLE = f"""{_GEO}, flipped as (select dst as src, src as dst from s), z as (select 'r' || r_regionkey as id from region),
a as (select 'o' || o_orderkey as id from orders join customer on c_custkey = o_custkey where c_nationkey = 7),
{_reach('fwd', 'a', 's')}, {_reach('bwd', 'z', 'flipped')}, inner_ids as materialized (select id from fwd where id in (from bwd)), middle as materialized (select id from inner_ids where id not in (from a) and id not in (from z))"""


def _single(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The orders of one nation, the regions, and the references between orders, customers, nations, their desks and regions."""
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    o = t["orders"].join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = [
        (t["orders"], ("o", "o_orderkey"), ("c", "o_custkey")), (o.where("o_orderpriority = '1-URGENT'"), ("o", "o_orderkey"), ("n", "c_nationkey")), (t["customer"], ("c", "c_custkey"), ("n", "c_nationkey")),
        (t["nation"], ("n", "n_nationkey"), ("r", "n_regionkey")), (t["nation"], ("n", "n_nationkey"), ("k", "n_nationkey")), (t["nation"], ("k", "n_nationkey"), ("r", "n_regionkey")),
    ]
    s = None
    for frame, src, dst in pairs:
        part = frame.select(name(*src).alias("src"), name(*dst).alias("dst"))
        s = part if s is None else s.unionByName(part)
    return o.where("c_nationkey = 7").select(name("o", "o_orderkey").alias("id")), t["region"].select(name("r", "r_regionkey").alias("id")), s.distinct().checkpoint()


@query(f"""with recursive {_SINGLE}, {_bfs('d', 'a', 's')}, via as (select e.dst as id, min(e.src) as via from s e join d x on x.id = e.src join d y on y.id = e.dst where y.depth = x.depth + 1 group by e.dst),
target as (select id from d where id in (from z) order by depth, id limit 1), walk(id) as (select id from target union all select via from walk join via using (id)),
r(cand, id) as (select m.id, a.id from middle m, a union select r.cand, s.dst from r join s on s.src = r.id where s.dst <> r.cand),
choke as (select id from middle where id not in (select cand from r where r.id in (from z)))
select i.id, i.id in (from a) as source, i.id in (from z) as sink, i.id in (from choke) as chokepoint, case when i.id in (from walk) then (select depth from d where d.id = i.id) end::INT as step from inner_ids i""")
def route_chokepoints(t: Tables):
    """What lies between the orders of a nation and the regions, which of it can't be left out, and its place on the
    shortest path."""
    checkpointing(t.spark)
    a, z, s = _single(t)
    schema = f"id {s.schema['src'].dataType.simpleString()}"
    out, a, z, s = routes.within(a, z, s)
    path = routes.shortest(a, z, s)
    choke = routes.chokepoints(a, z, s, path)
    flags = [(a.withColumn("source", F.lit(True)), "source"), (z.withColumn("sink", F.lit(True)), "sink"), (t.spark.createDataFrame([(x, True) for x in choke], f"{schema}, chokepoint boolean"), "chokepoint")]
    for frame, name in flags:
        out = out.join(frame, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.join(t.spark.createDataFrame([(x, i) for i, x in enumerate(path)], f"{schema}, step int"), "id", "left")


@query(f"""with recursive {_SINGLE}, ranked as materialized (select m.id, (select count(*) from s where s.dst = m.id)::DOUBLE as mass from middle m order by 2 desc, 1 limit 120),
gone as (select 'crosses' as kind, id as cand, id from ranked union all select 'requires', id, id from ranked union all select 'requires', r.id, s.src from ranked r join s on s.dst = r.id),
r(kind, cand, id) as (select k.kind, c.id, a.id from ranked c, a, (values ('crosses'), ('requires')) k(kind) where (k.kind, c.id, a.id) not in (select kind, cand, id from gone)
  union select r.kind, r.cand, s.dst from r join s on s.src = r.id where not exists (select 1 from gone g where g.kind = r.kind and g.cand = r.cand and g.id = s.dst)),
cut as (select k.kind, c.id, c.mass from ranked c, (values ('crosses'), ('requires')) k(kind) where (k.kind, c.id) not in (select kind, cand from r where id in (from z)))
select min(kind) as kind, id, any_value(mass) as mass from cut group by id order by mass desc, id limit 10""")
def propose_chokepoints(t: Tables):
    """What a contract between the orders of a nation and the regions could guarantee, by how many refer to it."""
    checkpointing(t.spark)
    a, z, s = _single(t)
    mass = s.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("mass"))
    return t.spark.createDataFrame(routes.propose(a, z, s, mass), f"kind string, id {s.schema['src'].dataType.simpleString()}, mass double")


_BACK = f"{_ROUTE}, {_bfs('d', 'z', 'flipped')}, nxt as (select e.src as id, min(e.dst) as nxt from s e join d x on x.id = e.src join d y on y.id = e.dst where x.depth = y.depth + 1 group by e.src)"
_PATHS = f"{_BACK}, walk(root, id, step) as (select id, id, 0 from d where id in (from a) and depth between 1 and 11 union all select root, nxt, step + 1 from walk join nxt using (id))"


def _paths(t: Tables) -> DataFrame:
    """(root, id, step): the shortest path of each root to the nearest sink, of 12 nodes at most; one row a node."""
    checkpointing(t.spark)
    a, z, s = _ends(t)
    back = graph.depths(z, _flip(s)).checkpoint()
    now = back.where("depth between 1 and 11").join(a, "id", "left_semi").select(F.col("id").alias("root"), "id", F.lit(0).alias("step"))
    out = now
    for step in range(1, 12):
        now = now.join(back.where("via is not null"), "id").select("root", F.col("via").alias("id"), F.lit(step).alias("step"))
        out = out.unionByName(now)
    return out.checkpoint()


@query(f"with recursive {_PATHS} select root, list(id order by step) as path from walk group by root")
def paths_to_sink(t: Tables):
    """F27, S16."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "id")))
    return _paths(t).groupBy("root").agg(ordered.alias("p")).select("root", F.transform("p", lambda x: x["id"]).alias("path"))


@query(f"""with recursive {_PATHS}, n as (select root, max(step) as last from walk group by root), total as (select count(*) as total from n)
select id, count(distinct root) as paths, round(count(distinct root) / any_value(total), 6) as share from walk join n using (root), total where step > 0 and step < last group by id having count(distinct root) / any_value(total) >= 0.02""")
def common_steps(t: Tables):
    """Interior nodes of many paths, here from 2 per cent."""
    p = _paths(t).withColumn("last", F.max("step").over(Window.partitionBy("root")))
    total = p.agg(F.count_distinct("root").alias("total"))
    each = p.where("step > 0 and step < last").groupBy("id").agg(F.count_distinct("root").alias("paths")).crossJoin(F.broadcast(total))  # one row
    return each.withColumn("s", F.col("paths") / F.col("total")).where("s >= 0.02").select("id", "paths", F.round("s", 6).alias("share"))


@query(f"""with recursive {_PATHS}, n as (select root, max(step) as last from walk group by root), total as (select count(*) as total from n),
g as (select distinct walk.root, s.dst as id from walk join n on n.root = walk.root and step < last join s on s.src = walk.id where s.dst not in (from z) and not exists (select 1 from walk w where w.root = walk.root and w.id = s.dst))
select id, count(*) as paths, round(count(*) / any_value(total), 6) as share from g, total group by id having count(*) / any_value(total) >= 0.02""")
def guards_discovered(t: Tables):
    """What paths call without passing it."""
    _, z, s = _ends(t)
    p = _paths(t)
    total = p.agg(F.count_distinct("root").alias("total"))
    inner = p.withColumn("last", F.max("step").over(Window.partitionBy("root"))).where("step < last").select("root", F.col("id").alias("src"))
    g = inner.join(s.select("src", F.col("dst").alias("id")), "src").select("root", "id").distinct().join(z, "id", "left_anti").join(p.select("root", "id"), ["root", "id"], "left_anti")
    each = g.groupBy("id").agg(F.count(F.lit(1)).alias("paths")).crossJoin(F.broadcast(total))
    return each.withColumn("s", F.col("paths") / F.col("total")).where("s >= 0.02").select("id", "paths", F.round("s", 6).alias("share"))


@query(f"with recursive {_PATHS}, n as (select distinct id from walk), o as (select src as id, count(*) as branches from s where src in (from n) group by src having count(*) > 1) select id, branches from o order by branches desc, id limit 10")
def branchings(t: Tables):
    """The ten nodes of paths that branch most."""
    _, _, s = _ends(t)
    n = _paths(t).select("id").distinct()
    return s.join(n.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("branches")).where("branches > 1").orderBy(F.desc("branches"), "id").limit(10)


@query(f"with {b.RETURNED}, {b.PARTS} select distinct d.module, d.id from edges join parts d on d.id = dst join parts s on s.id = src where strong and s.module <> d.module")
def gates_boundary(t: Tables):
    """parts that are called from outside their module."""
    p = b.parts(t)
    e = b.returned(t).where("strong").join(graph.apart(p.select(F.col("id").alias("dst"), "module")), "dst").join(graph.apart(p.select(F.col("id").alias("src"), F.col("module").alias("other"))), "src")
    return e.where("module <> other").select("module", F.col("dst").alias("id")).distinct()


@query(f"with recursive {_ROUTE} select file, count(*) as reached, count(*) filter (fwd.id not in (select src from s)) as terminals from fwd join parts using (id) group by file")
def forward_targets(t: Tables):
    """what is reached, by file, and how much of it goes no further."""
    a, _, s = _ends(t)
    ends = s.select(F.col("src").alias("id")).distinct().withColumn("on", F.lit(True))
    f = graph.closure(a, s).join(b.parts(t).select("id", "file"), "id").join(ends, "id", "left")
    return f.groupBy("file").agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("on").isNull()).alias("terminals"))


@query(f"""with recursive {b.RETURNED}, {b.PARTS}, {b.ROOTS}, s as (select src, dst from edges where strong), {_reach('every', 'roots', 'edges')}, {_reach('sure', 'roots', 's')}
select module, count(*) as symbols, count(*) filter (id in (from sure)) as unambiguous from every join parts using (id) group by module""")
def reach_two_grades(t: Tables):
    """Reach over all edges and over the unambiguous ones."""
    e = b.returned(t)
    sure = graph.closure(b.roots(t), e.where("strong")).withColumn("sure", F.lit(True))
    f = graph.closure(b.roots(t), e).join(b.parts(t).select("id", "module"), "id").join(sure, "id", "left")
    return f.groupBy("module").agg(F.count(F.lit(1)).alias("symbols"), F.count("sure").alias("unambiguous"))


_SERVICES = [("north", "Brand#1"), ("south", "Brand#2"), ("west", "Brand#3")]


@query(f"""with recursive {b.RETURNED}, {b.PARTS}, {b.ROOTS}, s as (select src, dst from edges where strong), entry(service, file) as (values {", ".join(map(str, _SERVICES))}),
hop as (select src, dst from s union all select p.id, r.id from parts p join parts r on r.file = p.file join roots on roots.id = r.id),
r(service, id) as (select service, id from entry join parts using (file) union select service, dst from r join hop on src = r.id)
select service, file, count(*) over (partition by file) > 1 as shared from (select distinct service, file from r join parts using (id))""")
def service_reach(t: Tables):
    """F36, E30, S23."""
    entry = t.spark.createDataFrame(_SERVICES, "service string, file string")
    reached = graph.services(entry, b.parts(t).select("id", "file"), b.returned(t).where("strong").select("src", "dst"), b.roots(t))
    return reached.select("service", "file", (F.count(F.lit(1)).over(Window.partitionBy("file")) > 1).alias("shared"))


@query(f"""with recursive {b.RETURNED}, {b.PARTS}, s as (select src, dst from edges where strong), start as (select id from parts where file = 'Brand#5'), {_reach('one', 'start', 's')},
door as (select id from one union all select p.id from parts p where p.module = 'SMALL' and exists (select 1 from one join parts q using (id) where q.module = 'SMALL')), {_bfs('d', 'door', 's')}
select id, id in (from one) as direct from d""")
def surface_reach_dispatch(t: Tables):
    """reach from a surface; the dispatch module's symbols open only if one of them was reached."""
    checkpointing(t.spark)
    p, s = b.parts(t), b.returned(t).where("strong")
    one = graph.closure(p.where("file = 'Brand#5'").select("id"), s).checkpoint()
    module = p.where("module = 'SMALL'").select("id")
    opens = not one.join(module, "id", "left_semi").isEmpty()
    every = graph.closure(one.unionByName(module) if opens else one, s)
    return every.join(one.withColumn("direct", F.lit(True)), "id", "left").select("id", F.coalesce("direct", F.lit(False)).alias("direct"))


@query(f"""with {b.RETURNED}, {b.PARTS}, kind as (select id, file, case when module in ('SMALL', 'MEDIUM') then 'observe' when module = 'STANDARD' then 'transport' else 'decide' end as layer from parts),
r as (select d.id, s.layer from edges join kind s on s.id = src join kind d on d.id = dst where s.file <> d.file)
select id, count(*) as readers from r group by id having count(*) filter (layer = 'decide') = 0""")
def no_consumer(t: Tables):
    """Parts that only observing or transporting modules outside their file refer to."""
    p = b.parts(t)
    layer = F.when(F.col("module").isin("SMALL", "MEDIUM"), "observe").when(F.col("module") == "STANDARD", "transport").otherwise("decide")
    r = b.returned(t).join(p.select(F.col("id").alias("src"), F.col("file").alias("a"), layer.alias("layer")), "src").join(p.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").where("a <> b")
    return r.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("readers"), F.count_if(F.col("layer") == "decide").alias("deciders")).where("deciders = 0").select("id", "readers")


@query("""with n as (select conv_id, turn, role, lead(turn) over w as nxt, length(text) > 400 as lane from conversations window w as (partition by conv_id order by turn)),
e as (select conv_id || ':' || turn as id, case when lane = lag(lane) over w then 0 else 1 end as fresh, conv_id, turn from n window w as (partition by conv_id order by turn)),
g as (select *, sum(fresh) over (partition by conv_id order by turn) as grp from e)
select id, first_value(id) over w as head, count(*) over (partition by conv_id, grp) as steps from g window w as (partition by conv_id, grp order by turn)""")
def chain_condense(t: Tables):
    """Turns of a conversation are a chain, cut where the length band changes."""
    c = t["conversations"].select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (F.length("text") > 400).alias("lane"))
    e = c.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("conv_id").orderBy("turn")).alias("dst")).where("dst is not null")
    return graph.condensed(e, c.select("id", "lane"))


@query(f"""with {b.RETURNED}, {b.PARTS}, k as (select src, dst, row_number() over (partition by src order by w desc, dst) as k, count(*) over (partition by src) as n from edges)
select src, list(dst order by dst) as told, any_value(n) - count(*) as pruned from k where k <= 3 group by src""")
def sequence_narrative(t: Tables):
    """Of each part's successors the three heaviest are told, in order; the rest is counted. One level only, as in its SQL; the
    whole tree is sequence_tree."""
    w = Window.partitionBy("src")
    k = b.returned(t).withColumn("k", F.row_number().over(w.orderBy(F.desc("w"), "dst"))).withColumn("n", F.count(F.lit(1)).over(w)).where("k <= 3")
    return k.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("told"), (F.first("n") - F.count(F.lit(1))).alias("pruned"))


_TOLD = " union all ".join(f"select * from l{k}" for k in range(5))
_LEVEL = "l{k} as (select list_append(path, e.dst) as path, {k} as depth, e.ordinal, e.dst as id, list_contains(path, e.dst) as repeats from l{j} join told e on e.src = l{j}.id where not repeats)"


@query(f"""with {b.RETURNED}, {b.ROOTS}, start as (select src as id from edges where src in (select id from roots) group by src order by sum(w) desc, src limit 1),
ranked as (select src, dst, count(*) over (partition by src) as n, row_number() over (partition by src order by w desc, dst) as k from edges where src <> dst),
told as (select src, dst, row_number() over (partition by src order by dst) as ordinal, n - count(*) over (partition by src) as pruned from ranked where k <= 8), cut as (select distinct src, pruned from told),
l0 as (select [id] as path, 0 as depth, 1 as ordinal, id, false as repeats from start), {", ".join(_LEVEL.format(k=k, j=k - 1) for k in range(1, 5))}
select path, depth, ordinal::INT as ordinal, id, repeats, case when depth < 4 and not repeats then coalesce(pruned, 0) else 0 end as pruned from ({_TOLD}) left join cut on src = id""")
def sequence_tree(t: Tables):
    """The whole narrative, 8 successors of each part and 4 levels, from the root of the heaviest edges. Parts have no
    lines, so successors are told in order of their ids."""
    e = b.returned(t)
    start = e.join(b.roots(t).select(F.col("id").alias("src")).distinct(), "src", "left_semi").groupBy("src").agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "src").limit(1).select(F.col("src").alias("id"))
    return graph.told(start, e.select("src", "dst", "w", F.col("dst").alias("place")))


@query("""with n as (select conv_id, turn, role || '/' || (length(text) // 400) as shape from conversations), x as (select *, case when shape = lag(shape) over w then 0 else 1 end as fresh from n window w as (partition by conv_id order by turn)),
g as (select *, sum(fresh) over (partition by conv_id order by turn) as run from x), r as (select conv_id, run, min(turn) as turn, any_value(shape) as shape, count(*) as times from g group by conv_id, run)
select conv_id, turn, shape, times, row_number() over (partition by conv_id, shape order by turn) > 1 as told from r""")
def sequence_collapse(t: Tables):
    """neighbours of one shape merge with a counter; a shape that was told before is marked."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = t["conversations"].select("conv_id", "turn", F.concat_ws("/", "role", F.floor(F.length("text") / 400).cast("string")).alias("shape"))
    g = n.withColumn("fresh", F.when(F.col("shape") == F.lag("shape").over(w), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    r = g.groupBy("conv_id", "run").agg(F.min("turn").alias("turn"), F.first("shape").alias("shape"), F.count(F.lit(1)).alias("times"))
    return r.select("conv_id", "turn", "shape", "times", (F.row_number().over(Window.partitionBy("conv_id", "shape").orderBy("turn")) > 1).alias("told"))


@query("""with s as (select distinct n_regionkey as project, l_partkey as literal from supplier join nation on n_nationkey = s_nationkey join lineitem on l_suppkey = s_suppkey),
c as (select n_regionkey as project, l_partkey as literal, count(*) as uses from customer join nation on n_nationkey = c_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by all)
select c.project as consumer, s.project as provider, count(*) as literals, sum(uses)::BIGINT as uses from c join s using (literal) where c.project <> s.project group by all""")
def weave_projects(t: Tables):
    """regions as projects; parts that one region's customers take and another's suppliers offer are the seams."""
    nation = t["nation"].select("n_nationkey", F.col("n_regionkey").alias("project"))
    lines = t["lineitem"].select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("literal"))
    offers = t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(lines, F.col("l_suppkey") == F.col("s_suppkey")).select("project", F.lit("part").alias("kind"), "literal")
    consumes = t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t["orders"], F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("project", F.lit("part").alias("kind"), "literal")
    return joins.across_projects(consumes, offers).groupBy("consumer", "provider").agg(F.count(F.lit(1)).alias("literals"), F.sum("uses").alias("uses"))
