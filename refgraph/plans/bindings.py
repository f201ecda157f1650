"""The canonical tables of the operators, made from the Parquet tables; for each binding the same thing as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refgraph.operators.graph import apart
from refgraph.plans.registry import Tables


def follows(lines: DataFrame) -> DataFrame:
    """(src, dst) of successive parts of an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null and src <> dst")


def seq(t: Tables) -> DataFrame:
    """(src, dst, w): how often one part follows another inside an order."""
    return follows(t["lineitem"]).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def unsummed(t: Tables) -> DataFrame:
    """``seq`` with a row for each time, for what sums by groups anyway."""
    return follows(t["lineitem"]).withColumn("w", F.lit(1.0))


SEQ = """e0 as (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem),
edges as (select src, dst, count(*)::DOUBLE as w from e0 where dst is not null and src <> dst group by src, dst)"""


def returned(t: Tables) -> DataFrame:
    """SEQ20, (src, dst, w, strong): the same over returned and finished lines of 20 pieces or more; an edge is strong if no
    other part has the name, brand and type of its target."""
    lines = t["lineitem"].where("l_returnflag = 'R' and l_linestatus = 'F' and l_quantity >= 20")
    e = follows(lines).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    n = F.count(F.lit(1)).over(Window.partitionBy("p_name", "p_brand", "p_type"))
    return e.join(apart(t["part"].select(F.col("p_partkey").alias("dst"), (n == 1).alias("strong"))), "dst").select("src", "dst", "w", "strong")


RETURNED = """e0 as (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst
  from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_quantity >= 20),
named as (select p_partkey, count(*) over (partition by p_name, p_brand, p_type) = 1 as strong from part),
edges as (select src, dst, count(*)::DOUBLE as w, any_value(strong) as strong from e0 join named on p_partkey = dst where src <> dst group by src, dst)"""


def parts(t: Tables) -> DataFrame:
    """(id, name, file, module, line, end): file is the brand, module the type."""
    p = t["part"]
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_brand", "p_type").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("module"), F.col("p_partkey").alias("line"), (F.col("p_partkey") + F.col("p_size")).alias("end"))


PARTS = "parts as (select p_partkey as id, p_name || '|' || p_brand || '|' || p_type as name, p_brand as file, p_type as module, p_partkey as line, p_partkey + p_size as \"end\" from part)"


def roots(t: Tables) -> DataFrame:
    """(id, product): parts in promotion; small ones are of the product."""
    return t["part"].where("p_type = 'PROMO'").select(F.col("p_partkey").alias("id"), (F.col("p_size") <= 25).alias("product"))


ROOTS = "roots as (select p_partkey as id, p_size <= 25 as product from part where p_type = 'PROMO')"


def imported(t: Tables) -> DataFrame:
    """(file, dst, strong): what a brand's module refers to on import, its smallest parts; strong if their price is 1,000 at least."""
    return t["part"].where("p_size = 1").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("dst"), (F.col("p_retailprice") >= 1000).alias("strong"))


IMPORTED = "imported as (select p_brand as file, p_partkey as dst, p_retailprice >= 1000 as strong from part where p_size = 1)"


def journeys(t: Tables) -> DataFrame:
    """EVT, (src, dst, w): event types that follow each other for a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t["events"].select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null")
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


JOURNEYS = """j0 as (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events),
edges as (select src, dst, count(*)::DOUBLE as w from j0 where dst is not null group by src, dst)"""

TRANSITIONS = "p as (select src, dst, w / sum(w) over (partition by src) as p from edges where src <> dst)"


def chained(first: str, step: str, rounds: int) -> str:
    """CTEs r0 to r<rounds>; ``step`` names the one before as {r}."""
    return ",\n".join([f"r0 as materialized ({first})", *(f"r{k} as materialized ({step.format(r=f'r{k - 1}')})" for k in range(1, rounds + 1))])


def hosts(t: Tables) -> DataFrame:
    """SEAM, (page_id, project, segment, html): host, and first path segment."""
    p = t["pages"]
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("project"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]+)", 1).alias("segment"), "html")


HOSTS = "hosts as (select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as project, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) as segment, html from pages)"


def hrefs(t: Tables) -> DataFrame:
    """(project, literal): first path segment of every link of a page."""
    return hosts(t).select("project", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"/?#]+)'), F.lit(1))).alias("literal"))


HREFS = """hrefs as (select project, unnest(regexp_extract_all(html, 'href="/([^"/?#]+)', 1)) as literal from hosts)"""
