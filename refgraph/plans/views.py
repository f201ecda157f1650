"""Queries of the composite views: what was seen running, descriptions of groups, reach, islands, flows, decisions, projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refgraph.operators import graph, joins, similarity
from refgraph.plans import bindings as b
from refgraph.plans import flows, structure
from refgraph.plans.registry import SQL, Tables, query
from refgraph.session import checkpointing

_SINCE = "2001-09-15 00:00:00"
_OBSERVED = f"observed as (select l_partkey as id, min(l_shipdate) as t from lineitem where l_shipdate >= timestamp '{_SINCE}' group by 1)"


def _observed(t: Tables) -> DataFrame:
    """(id, t): parts that were seen running, and when first: those shipped late."""
    return t["lineitem"].where(f"l_shipdate >= timestamp_ntz'{_SINCE}'").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_shipdate").alias("t"))


def _own(name: str) -> str:
    """The SQL of a registered query as a subselect."""
    return f"({SQL[name]})"


@query(f"""with {_OBSERVED}, o as (select l_orderkey as cond, l_returnflag as branch, count(distinct l_partkey) filter (l_partkey in (select id from observed)) as seen from lineitem group by all),
g as (select cond, list(branch order by branch) filter (seen > 0) as happen, list(branch order by branch) filter (seen = 0) as rest from o group by cond having count(*) >= 2)
select cond, case when happen is not null and rest is null then 'every branch happens' when len(happen) = 1 then 'compatible with ' || happen[1] when happen is null then 'no branch observed' else 'some happen' end as runtime,
  coalesce(happen, []) as happen from g""")
def fork_runtime(t: Tables):
    """orders as forks, return flags as their branches; what of them is compatible with what was seen."""
    calls = t["lineitem"].select(F.lit("order").alias("src"), F.col("l_orderkey").alias("cond"), F.col("l_returnflag").alias("branch"), F.col("l_partkey").alias("dst"))
    return graph.forks_at_runtime(calls, _observed(t)).select("cond", "runtime", "happen")


@query(r"""with w as (select doc_id, source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents),
g as (select doc_id, starts_with(source, 'src1') as new, list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) as g from w),
e as (select doc_id, new, len(g) as n, unnest(g) as x from g),
c as (select a.doc_id, o.doc_id as other, count(*) / (any_value(a.n) + any_value(o.n) - count(*)) as j from e a join e o using (x) where a.new and not o.new group by all having count(*) >= 3)
select doc_id, arg_min(other, (-round(j, 6), other)) as twin, round(max(j), 2) as jaccard from c where j >= 0.8 group by doc_id""")
def duplicates_introduced(t: Tables):
    """Documents of new sources against those of old ones, each with its nearest by exact Jaccard of 5-grams."""
    units = t["documents"].select("doc_id", "text", F.col("source").startswith("src1").alias("side"))
    return similarity.twins(units, "doc_id", "text", "side").select("doc_id", "twin", F.round("jaccard", 2).alias("jaccard"))


@query(f"""with {b.RETURNED}, mine as (select distinct dst as id from edges), theirs as (select p_partkey as id from part where p_size > 10),
every as (select src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem where l_quantity >= 45) where dst is not null and src <> dst)
select 'only mine' as kind, count(*) as n from mine where id not in (from theirs) union all select 'only theirs', count(*) from theirs where id not in (from mine) union all select 'both', count(*) from mine where id in (from theirs)
union all select 'missing calls', count(*) from (select distinct src, dst from every where src in (from mine) and dst in (from mine) and (src, dst) not in (select src, dst from edges))""")
def inventory_diff(t: Tables):
    """Our parts and references against those of another extractor."""
    checkpointing(t.spark)
    mine = b.returned(t).select("src", "dst").checkpoint()
    theirs = b.follows(t["lineitem"].where("l_quantity >= 45"))
    return joins.inventory_diff(mine.select(F.col("dst").alias("id")), mine, t["part"].where("p_size > 10").select(F.col("p_partkey").alias("id")), theirs)


@query(f"with {_OBSERVED}, l as (from {_own('liveness_levels')}) select level, count(*) as symbols, count(*) filter (id in (select id from observed)) as proven from l group by level")
def census_levels(t: Tables):
    """E5: symbols of each level, and how many of them were seen running."""
    seen = _observed(t).select("id", F.lit(True).alias("seen"))
    return flows.liveness_levels(t).join(graph.apart(seen), "id", "left").groupBy("level").agg(F.count(F.lit(1)).alias("symbols"), F.count("seen").alias("proven"))


@query(f"""with {b.PARTS}, {b.ROOTS}, r as (select id, product, split_part(name, ' ', 1) as reason from roots join parts using (id))
select reason, count(*) as roots, count(*) filter (product) as product, list(id order by id)[1:5] as ids from r group by reason""")
def root_reasons(t: Tables):
    """Roots by their reason, with the first five of each."""
    r = b.roots(t).join(b.parts(t).select("id", F.substring_index("name", " ", 1).alias("reason")), "id")
    k = r.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("id")))
    ids = F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("id"))))
    return k.groupBy("reason").agg(F.count(F.lit(1)).alias("roots"), F.count_if("product").alias("product"), ids.alias("ids"))


@query(f"""with {b.SEQ}, {b.PARTS}, m as (select dst as id, sum(w) as mass from edges group by 1), g as (select split_part(name, ' ', 1) as grp, parts.*, coalesce(mass, 0) as mass from parts left join m using (id)),
f as (select grp, file, count(*) as n from g group by all), best as (select grp, list(file order by n desc, file)[1:3] as files from f group by grp)
select grp, count(*) as members, count(distinct file) as n_files, count(distinct module) as n_modules, sum(mass)::BIGINT as mass, arg_min(name, (-mass, name, id)) as heaviest, any_value(best.files) as files from g join best using (grp) group by grp""")
def group_description(t: Tables):
    """Groups (the first word of a part's name) with their files, modules, mass and heaviest member, ties by name."""
    mass = b.seq(t).groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("mass"))
    g = b.parts(t).join(mass, "id", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0))).withColumn("grp", F.substring_index("name", " ", 1))
    f = g.groupBy("grp", "file").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "file"))).where("k <= 3")
    files = f.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "file"))), lambda x: x["file"]).alias("files"))
    each = g.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("file").alias("n_files"), F.count_distinct("module").alias("n_modules"), F.sum("mass").cast("long").alias("mass"), F.min(F.struct((-F.col("mass")).alias("m"), "name", "id")).alias("x"))
    return each.join(files, "grp").select("grp", "members", "n_files", "n_modules", "mass", F.col("x.name").alias("heaviest"), "files")


_WALKED = b.chained("select id, 1.0::DOUBLE as v from roots", "select dst as id, 0.85 * sum(v * p) as v from {r} join p on src = id group by dst", 10)


@query(f"""with recursive {_OBSERVED}, {b.RETURNED}, {b.PARTS}, {b.ROOTS}, {b.TRANSITIONS}, s as (select src, dst from edges where strong), {flows._reach('every', 'roots', 'edges')}, {flows._reach('sure', 'roots', 's')}, {_WALKED},
seen as (select id, sum(v) as v from ({' union all '.join(f'from r{k}' for k in range(11))}) group by id), total as (select sum(v) as total from seen)
select module, count(*) as symbols, count(*) filter (id in (from sure)) as unambiguous, round(coalesce(sum(v), 0) / any_value(total), 6) as share, count(*) filter (id in (select id from observed)) as executed
from every join parts using (id) left join seen using (id), total group by module""")
def reach_by_module(t: Tables):
    """Reach of the roots by module at two grades, with its share of visits (10 fronts) and what was executed."""
    checkpointing(t.spark)
    e, roots = b.returned(t).checkpoint(), b.roots(t).select("id")
    visits = graph.visits(roots, graph.transitions(e), rounds=10, tolerance=0.0)
    total = visits.agg(F.sum("visits").alias("total"))
    sure = graph.closure(roots, e.where("strong")).withColumn("sure", F.lit(True))
    f = graph.closure(roots, e).join(b.parts(t).select("id", "module"), "id").join(sure, "id", "left").join(visits, "id", "left").join(_observed(t).select("id", F.lit(True).alias("seen")), "id", "left")
    each = f.groupBy("module").agg(F.count(F.lit(1)).alias("symbols"), F.count("sure").alias("unambiguous"), F.coalesce(F.sum("visits"), F.lit(0.0)).alias("v"), F.count("seen").alias("executed"))
    return each.crossJoin(F.broadcast(total)).select("module", "symbols", "unambiguous", F.round(F.col("v") / F.col("total"), 6).alias("share"), "executed")  # total is one row


@query(f"""with {_OBSERVED} select count(*) as observed, (select count(*) from part) as total, round(100.0 * count(*) / (select count(*) from part), 1) as pct, coalesce(date_diff('second', min(t), max(t)), 0) as window_s from observed""")
def census_window(t: Tables):
    """How much was seen running, and over which time."""
    seen = _observed(t).agg(F.count(F.lit(1)).alias("observed"), F.coalesce(F.unix_timestamp(F.max("t").cast("timestamp")) - F.unix_timestamp(F.min("t").cast("timestamp")), F.lit(0)).alias("window_s"))
    return seen.crossJoin(F.broadcast(t["part"].agg(F.count(F.lit(1)).alias("total")))).select("observed", "total", F.round(100.0 * F.col("observed") / F.col("total"), 1).alias("pct"), "window_s")  # one row each


@query(f"""with {b.HOSTS}, {b.HREFS} select literal, list(distinct project order by project)[1:8] as first_projects, count(distinct project) as projects, count(*) as uses from hrefs group by literal having count(distinct project) >= 2""")
def shared_resources(t: Tables):
    """Literals that two projects or more touch, with the first eight of them."""
    each = b.hrefs(t).groupBy("literal", "project").agg(F.count(F.lit(1)).alias("uses"))
    k = each.withColumn("k", F.row_number().over(Window.partitionBy("literal").orderBy("project")))
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= 8, F.col("project"))))
    return k.groupBy("literal").agg(first.alias("first_projects"), F.count(F.lit(1)).alias("projects"), F.sum("uses").alias("uses")).where("projects >= 2")


@query(r"""with p as (select regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') as file from pages), d as (select case when contains(file, '/') then regexp_extract(file, '^(.*/)', 1) else file end as dir from p)
select dir, count(*) as n from d group by dir order by n desc, dir limit 40""")
def internal_parts(t: Tables):
    """What a site consists of, by directory; the forty largest."""
    file = F.regexp_replace("url", "^[a-z]+://|[?#].*$", "")
    d = t["pages"].select(F.when(file.contains("/"), F.regexp_extract(file, "^(.*/)", 1)).otherwise(file).alias("dir"))
    return d.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(40)


@query(f"""with {b.RETURNED}, {b.PARTS}, i as (from {_own('islands_components')}), sized as (select file, island, count(*) as n from i group by all),
sym as (select src, dst, sum(w) as w from (select src, dst, w from edges where src <> dst union all select dst, src, w from edges where src <> dst) group by src, dst),
c as (select s.file, sum(case when s.file = d.file then w else 0 end) / sum(w) as cohesion from sym join parts s on s.id = src join parts d on d.id = dst group by 1),
x as (select file, sum(n)::BIGINT as symbols, max(n) / sum(n) as largest, count(*) filter (n >= 2) as islands from sized group by file having sum(n) >= 10)
select file, symbols, round(coalesce(cohesion, 0), 2) as cohesion, round(largest, 2) as largest, islands,
  case when largest >= 0.6 then 'one big thing' when coalesce(cohesion, 0) < 0.15 then 'not cohesive' when islands >= 3 then 'split along the islands' else 'no clear signal' end as verdict from x left join c using (file)""")
def island_verdicts(t: Tables):
    """Whether a file of ten symbols or more is one thing, several, or none."""
    checkpointing(t.spark)
    e, p = b.returned(t).checkpoint(), b.parts(t)
    return graph.island_verdicts(graph.islands(e, p), graph.cohesion(e, p.select("id", F.col("file").alias("grp")))).select("file", "symbols", F.round("cohesion", 2).alias("cohesion"), F.round("largest", 2).alias("largest"), "islands", "verdict")


@query(f"""with {b.RETURNED}, {b.PARTS}, x as (select s.file as src_file, d.file as dst_file, bool_or(strong) as strong from edges join parts s on s.id = src join parts d on d.id = dst where s.file <> d.file group by all)
select src_file, count(*) filter (strong) as listed, count(*) filter (not strong) as ambiguous_only from x group by src_file""")
def neighbours_ambiguous(t: Tables):
    """Of a file's neighbours how many are listed, and how many only ambiguous references name."""
    p = b.parts(t)
    e = b.returned(t).join(p.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(p.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst").where("src_file <> dst_file")
    each = e.groupBy("src_file", "dst_file").agg(F.bool_or("strong").alias("strong"))
    return each.groupBy("src_file").agg(F.count_if("strong").alias("listed"), F.count_if(~F.col("strong")).alias("ambiguous_only"))


@query(f"""with {b.RETURNED}, {b.PARTS}, x as (select s.module as a, d.module as z, s.file as fa, d.file as fz, w from edges join parts s on s.id = src join parts d on d.id = dst where strong and (s.module = 'PROMO') <> (d.module = 'PROMO'))
select case when z = 'PROMO' then 'into' else 'out of' end as way, case when z = 'PROMO' then a else z end as module, round(sum(w), 1) as refs from x where case when z = 'PROMO' then fa else fz end <> 'Brand#1' group by all""")
def neighbours_of_target(t: Tables):
    """Strong references into and out of promotion by the module at the other end, which must be of the product (not Brand#1)."""
    p = b.parts(t)
    e = b.returned(t).where("strong").join(graph.apart(p.select(F.col("id").alias("src"), F.col("module").alias("a"), F.col("file").alias("fa"))), "src").join(graph.apart(p.select(F.col("id").alias("dst"), F.col("module").alias("z"), F.col("file").alias("fz"))), "dst")
    into = F.col("z") == "PROMO"
    x = e.where(into != (F.col("a") == "PROMO")).where(F.when(into, F.col("fa")).otherwise(F.col("fz")) != "Brand#1")
    return x.groupBy(F.when(into, "into").otherwise("out of").alias("way"), F.when(into, F.col("a")).otherwise(F.col("z")).alias("module")).agg(F.round(F.sum("w"), 1).alias("refs"))


@query(f"""with {b.PARTS}, m as (from {_own('pagerank_personalised')}), d as (from {_own('depth_from_roots')}), l as (select id, arg_min(level, case level when 'PRODUCT' then 1 when 'PRODUCT_WEAK' then 2 when 'NOT_PRODUCT' then 3 when 'DEAD' then 5 else 4 end) as status from {_own('liveness_levels')} group by id),
x as (select parts.id, module, file, coalesce(mass, 0) as mass, depth, status from parts left join m using (id) left join d using (id) left join l using (id))
select case when grouping(module) = 0 then 'module' when grouping(file) = 0 then 'file' else 'all' end as level, module, file, count(*) as members, round(sum(mass), 4) as mass, min(depth) as depth, count(*) filter (depth is null) as loose,
  count(*) filter (status = 'PRODUCT') as product, count(*) filter (status = 'PRODUCT_WEAK') as product_weak, count(*) filter (status = 'NOT_PRODUCT') as not_product, count(*) filter (status = 'DEAD') as dead from x group by grouping sets ((module), (file), ())""")
def map_rollup_status(t: Tables):
    """Mass, least depth, loose symbols (those at no depth) and levels of modules, of files and of all."""
    order = F.when(F.col("level") == "PRODUCT", 1).when(F.col("level") == "PRODUCT_WEAK", 2).when(F.col("level") == "NOT_PRODUCT", 3).when(F.col("level") == "DEAD", 5).otherwise(4)
    status = flows.liveness_levels(t).groupBy("id").agg(F.min_by("level", order).alias("status"))
    x = b.parts(t).select("id", "module", "file").join(graph.apart(flows.pagerank_personalised(t)), "id", "left").join(graph.apart(flows.depth_from_roots(t)), "id", "left").join(graph.apart(status), "id", "left").fillna(0.0, ["mass"])
    level = F.when(F.grouping("module") == 0, "module").when(F.grouping("file") == 0, "file").otherwise("all")
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PRODUCT", "PRODUCT_WEAK", "NOT_PRODUCT", "DEAD")]
    return x.groupingSets([["module"], ["file"], []], "module", "file").agg(level.alias("level"), F.count(F.lit(1)).alias("members"), F.round(F.sum("mass"), 4).alias("mass"), F.min("depth").alias("depth"), F.count_if(F.col("depth").isNull()).alias("loose"), *counts)


@query(f"""with {b.PARTS}, m as (from {_own('pagerank_personalised')}) select module, round(sum(mass), 4) as mass, count(*) as members, count(distinct file) as files, arg_min(case when file like 'Brand#1%' then 'area one' else 'core' end, file) as area from m join parts using (id) group by module""")
def mass_by_module_area(t: Tables):
    """With distinct files, and the area of the first file."""
    area = F.when(F.col("file").startswith("Brand#1"), "area one").otherwise("core")
    each = flows.pagerank_personalised(t).join(b.parts(t), "id").groupBy("module")
    return each.agg(F.round(F.sum("mass"), 4).alias("mass"), F.count(F.lit(1)).alias("members"), F.count_distinct("file").alias("files"), F.min_by(area, "file").alias("area"))


@query(f"""with recursive {flows._ROUTE}, m as (from {_own('pagerank_personalised')}), out_ids as (select id from fwd where id not in (from a))
select file, count(*) as n, count(*) filter (id not in (select src from s)) as terminals, round(sum(coalesce(mass, 0)), 4) as mass from out_ids join parts using (id) left join m using (id) group by file order by mass desc, file limit 8""")
def flow_targets(t: Tables):
    """where a flow goes on, by file: the eight files of most mass, with the symbols that call nothing further."""
    a, _, s = flows._ends(t)
    ends = s.select(F.col("src").alias("id")).distinct().withColumn("on", F.lit(True))
    f = graph.closure(a, s).join(a, "id", "left_anti").join(b.parts(t).select("id", "file"), "id").join(ends, "id", "left").join(flows.pagerank_personalised(t), "id", "left")
    each = f.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("on").isNull()).alias("terminals"), F.round(F.sum(F.coalesce("mass", F.lit(0.0))), 4).alias("mass"))
    return each.orderBy(F.desc("mass"), "file").limit(8)


_SECTIONS = {"steps": ("common_steps", "id", "share"), "guards": ("guards_discovered", "id", "share"), "branches": ("branchings", "id", "branches"), "targets": ("flow_targets", "file", "mass")}
_LONGEST = f"(select 'example' as section, list_aggregate(path, 'string_agg', '>') as name, len(path)::DOUBLE as value from {_own('paths_to_sink')} order by len(path) desc, path desc limit 1)"


@query(" union all ".join([*(f"select '{s}' as section, {k}::VARCHAR as name, {v}::DOUBLE as value from {_own(q)}" for s, (q, k, v) in _SECTIONS.items()), f"from {_LONGEST}"]))
def flow_trace(t: Tables):
    """a target's whole route: steps, guards, branchings, where it goes on, and the longest path as the example."""
    found = {"common_steps": flows.common_steps, "guards_discovered": flows.guards_discovered, "branchings": flows.branchings, "flow_targets": flow_targets}
    p = flows.paths_to_sink(t).orderBy(F.size("path").desc(), F.desc("path")).limit(1)
    out = p.select(F.lit("example").alias("section"), F.array_join(F.col("path").cast("array<string>"), ">").alias("name"), F.size("path").cast("double").alias("value"))
    for section, (name, key, value) in _SECTIONS.items():
        out = out.unionByName(found[name](t).select(F.lit(section).alias("section"), F.col(key).cast("string").alias("name"), F.col(value).cast("double").alias("value")))
    return out


_INNER = f"""{flows._ROUTE}, inner_ids as materialized (select id from fwd where id in (from bwd)), p0 as (select src, dst, w from edges where src <> dst and src in (from inner_ids) and dst in (from inner_ids)),
p as materialized (select src, dst, w / sum(w) over (partition by src) as p from p0), {b.chained("select id, 1.0::DOUBLE as v from a where id in (from inner_ids)", "select dst as id, 0.85 * sum(v * p) as v from {r} join p on src = id group by dst", 10)},
seen as (select id, sum(v) as visits from ({' union all '.join(f'from r{k}' for k in range(11))}) group by id)"""


@query(f"""with recursive {_INNER}, d as (select src as id, count(*) as branches, max(p) as largest from p group by src having count(*) >= 2 and max(p) < 0.98)
select id, branches, round(visits, 5) as visits, round(visits * (1 - largest), 5) as weight from d join seen using (id)""")
def decision_map(t: Tables):
    """the decisions on a route: transitions kept to what lies on it, visits from its sources (10 fronts), weighed by doubt."""
    checkpointing(t.spark)
    a, z, s = flows._ends(t)
    on = graph.closure(a, s).join(graph.closure(z, flows._flip(s)), "id", "left_semi").checkpoint()
    p = graph.transitions(b.returned(t), on).checkpoint()
    seen = graph.visits(a.join(on, "id", "left_semi"), p, rounds=10, tolerance=0.0)
    return graph.decisions(p, seen).join(seen, "id").select("id", "branches", F.round("visits", 5).alias("visits"), F.round("weight", 5).alias("weight"))


_SURFACES = [("console", "Brand#5:blue"), ("console", "red widget|Brand#7|PROMO"), ("hook", "Brand#11:"), ("hook", "nothing:here")]


@query(f"""with {b.PARTS}, q(surface, target) as (values {", ".join(map(str, _SURFACES))}), x as (select surface, target, contains(target, ':') as path, split_part(target, ':', 1) as file, case when contains(target, ':') then split_part(target, ':', 2) else target end as name from q),
hit as (select surface, target, id from x join parts on (not path or parts.file = x.file) and x.name <> '' and (parts.name = x.name or split_part(parts.name, ' ', 1) = x.name)),
loose as (select surface, target, id from x join parts using (file) where path and (surface, target) not in (select surface, target from hit))
select surface, target, count(*) as roots, min(id) as first, how from (select *, 'symbol' as how from hit union all select *, 'file' from loose) group by all""")
def surface_roots(t: Tables):
    """roots named by surfaces, ``file:symbol`` or a bare name; where the symbol isn't found, all symbols of the file."""
    q = t.spark.createDataFrame(_SURFACES, "surface string, target string")
    names = b.parts(t).select("id", "file", "name").withColumn("short", F.substring_index("name", " ", 1))
    return joins.surfaces(q, names).groupBy("surface", "target", "how").agg(F.count(F.lit(1)).alias("roots"), F.min("id").alias("first"))


_UNION = """n as (select n_nationkey, n_regionkey as project from nation), own as (select c.project, 'c' || c_custkey as src, 'o' || o_orderkey as dst, count(*)::DOUBLE as w from customer join n c on c.n_nationkey = c_nationkey join orders on o_custkey = c_custkey group by all),
seam as (select distinct c.project as a, 'o' || o_orderkey as src, s.project as z, 's' || s_suppkey as dst from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join n c on c.n_nationkey = c_nationkey join supplier on s_suppkey = l_suppkey join n s on s.n_nationkey = s_nationkey
  where l_quantity >= 48 and c.project <> s.project)"""


def _woven(t: Tables) -> DataFrame:
    project = t["nation"].select("n_nationkey", F.col("n_regionkey").alias("project"))
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    c = t["customer"].join(project, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "project").join(t["orders"].select("o_orderkey", "o_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    own = c.groupBy("project", name("c", "c_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    s = t["supplier"].join(project.withColumnRenamed("project", "other"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "other")
    seams = t["lineitem"].where("l_quantity >= 48").join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("project <> other")
    seams = seams.select(F.col("project").alias("a"), name("o", "o_orderkey").alias("src"), F.col("other").alias("z"), name("s", "s_suppkey").alias("dst"))
    return joins.woven(own, seams)


@query(f"""with {_UNION}, e as (select project as a, project as z, project || '/' || src as src, project || '/' || dst as dst, w, false as seam from own union all select a, z, a || '/' || src, z || '/' || dst, 1.0, true from seam)
select split_part(src, '/', 1) as from_project, split_part(dst, '/', 1) as to_project, seam, count(*) as refs, sum(w)::BIGINT as weight from e group by all""")
def weave_union(t: Tables):
    """regions as projects in one graph: names carry the project, seams are edges of weight 1."""
    e = _woven(t)
    return e.groupBy(F.substring_index("src", "/", 1).alias("from_project"), F.substring_index("dst", "/", 1).alias("to_project"), "seam").agg(F.count(F.lit(1)).alias("refs"), F.sum("w").cast("long").alias("weight"))


@query(f"""with {_UNION}, sh as (select z || '/' || dst as dst, count(distinct a) as projects from seam group by 1)
select 'module' as kind, project::VARCHAR as name, count(*) as n from own group by project union all select 'seam', a || '>' || z, count(*) from seam group by a, z union all select 'shared', dst, projects from sh where projects >= 3""")
def workspace_map(t: Tables):
    """every project's size, the seams between projects, and what three projects or more reach."""
    e = _woven(t)
    a, z = F.substring_index("src", "/", 1), F.substring_index("dst", "/", 1)
    own = e.where("not seam").groupBy(a.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("module").alias("kind"), "name", "n")
    seams = e.where("seam").groupBy(F.concat_ws(">", a, z).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("seam").alias("kind"), "name", "n")
    shared = e.where("seam").groupBy(F.col("dst").alias("name")).agg(F.count_distinct(a).alias("n")).where("n >= 3").select(F.lit("shared").alias("kind"), "name", "n")
    return own.unionByName(seams).unionByName(shared)


def _nations(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(src, dst, w) between nations by lines of large quantity, and their regions as groups."""
    c = t["customer"].select("c_custkey", F.col("c_nationkey").alias("src")).join(t["orders"].select("o_orderkey", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    lines = t["lineitem"].where("l_quantity >= 40").join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(t["supplier"].select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")), t["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("grp"))


@query()
def inflation_sweep(t: Tables):
    """modularity of the found groups for three inflations, and of the declared ones, all on the graph without hubs; tested on a small graph."""
    w, g = _nations(t)
    return graph.swept(w, g, (1.4, 2.0, 2.5), least=2, rounds=8).select("inflation", "k", F.round("q", 3).alias("q"))


@query()
def submodules(t: Tables):
    """whether a module is several: its best partition over two inflations, inside it alone; tested on a small graph."""
    w, g = _nations(t)
    return graph.submodules(w, g, (1.4, 2.0), symbols=3, least=2, rounds=8).select("module", "symbols", F.round("cohesion", 3).alias("cohesion"), F.round("q", 3).alias("q"), "k", "inflation")


_ABOUT = {
    "neighbours": ("way || ' ' || module", "refs", "neighbours_of_target", ""),
    "levels": ("level", "count(*)", "liveness_levels", "join parts using (id) where parts.module = 'PROMO' group by level"),
    "doors": ("'doors'", "count(*)", "gates_boundary", "where module = 'PROMO'"),
    "cohesion": ("module", "cohesion", "cohesion_by_module", "where module = 'PROMO'"),
    "heaviest": ("name", "mass", "pagerank_personalised", "join parts using (id) where parts.module = 'PROMO' order by mass desc, id limit 5"),
}


@query(f"with {b.PARTS} " + " union all ".join(f"(select '{s}' as section, {k} as name, ({v})::DOUBLE as value from {_own(q)} {rest})" for s, (k, v, q, rest) in _ABOUT.items()))
def orient(t: Tables):
    """2.7: what to know of a target before work on it: its neighbours, how alive it is, its doors, cohesion and heaviest parts."""
    p = b.parts(t).where("module = 'PROMO'").select("id", F.col("name").alias("called"))
    row = lambda section, frame, name, value: frame.select(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    n = neighbours_of_target(t)
    out = row("neighbours", n, F.concat_ws(" ", "way", "module"), F.col("refs"))
    alive = flows.liveness_levels(t).join(graph.apart(p), "id").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(row("levels", alive, F.col("level"), F.col("n")))
    doors = flows.gates_boundary(t).where("module = 'PROMO'").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(row("doors", doors, F.lit("doors"), F.col("n")))
    out = out.unionByName(row("cohesion", structure.cohesion_by_module(t).where("module = 'PROMO'"), F.col("module"), F.col("cohesion")))
    heavy = flows.pagerank_personalised(t).join(graph.apart(p), "id").orderBy(F.desc("mass"), "id").limit(5)
    return out.unionByName(row("heaviest", heavy, F.col("called"), F.col("mass")))
