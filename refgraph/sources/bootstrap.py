"""What a project's files say about how it starts, and a first configuration from it.

Everything is an aggregate over file names and facts, with the file that said it; what is a guess is marked as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE_FOLDERS = ("src", "lib", "app", "backend", "server")
TEST_FOLDERS = ("tests", "test", "testing", "spec")
AUX_FOLDERS = ("scripts", "tools", "docs", "examples", "benchmarks", "migrations")
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
#: Decorators that register nothing.
PLAIN = ("property", "staticmethod", "classmethod", "dataclass", "cache", "lru_cache", "wraps", "abstractmethod", "override", "setter", "contextmanager", "overload")


def _segments(file: str) -> F.Column:
    return F.slice(F.split(file, "/"), 1, F.size(F.split(file, "/")) - 1)


def _auxiliary(file: str) -> F.Column:
    return F.exists(_segments(file), lambda x: x.isin(*TEST_FOLDERS, *AUX_FOLDERS) | x.startswith("scratch")) | F.regexp_extract(file, r"([^/]+)$", 1).rlike(r"^(test_|conftest)|_test\.py$")


def detected(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """(kind, name, n, files, origin) for sources(file, text) and their facts: source root, test, auxiliary and scratch folders,
    decorators (of two files or more; in one they are maybes), route objects and methods, entry points, doors."""
    files = sources.select("file").distinct()
    total = files.agg(F.count(F.lit(1)).alias("total"))
    one = files.where(F.col("file").contains("/")).groupBy(F.substring_index("file", "/", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("origin"))
    root = one.where(F.col("name").isin(*SOURCE_FOLDERS)).crossJoin(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(3), F.col("total") * 0.5))  # one row
    out = root.select(F.lit("source root").alias("kind"), "name", "n", F.col("n").alias("files"), "origin")

    each = files.select("file", F.explode(_segments("file")).alias("name"))
    kind = F.when(F.col("name").startswith("scratch"), "scratch folder").when(F.col("name").isin(*TEST_FOLDERS), "test folder").when(F.col("name").isin(*AUX_FOLDERS), "auxiliary folder")
    out = out.unionByName(each.withColumn("kind", kind).where("kind is not null").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"), F.min("file").alias("origin")))

    d = facts.where("kind = 'decorator'").where(~_auxiliary("file")).select("file", F.col("detail").alias("whole"), F.substring_index("detail", ".", -1).alias("last"), F.col("detail").contains(".").alias("dotted"))
    d = d.where(~F.col("last").isin(*PLAIN))
    seen = [F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"), F.min("file").alias("origin")]
    bare = d.where("not dotted").groupBy(F.col("whole").alias("name")).agg(*seen)
    out = out.unionByName(bare.select(F.when(F.col("files") >= 2, "decorator").otherwise("maybe decorator").alias("kind"), "name", "n", "files", "origin"))
    routed = d.where("dotted").withColumn("verb", F.col("last").isin(*VERBS))
    objects = routed.groupBy(F.substring_index("whole", ".", 1).alias("name")).agg(F.count_if("verb").alias("verbs"), *seen)
    out = out.unionByName(objects.where("verbs > 0").select(F.lit("route object").alias("kind"), "name", F.col("verbs").alias("n"), "files", "origin"))
    out = out.unionByName(objects.where("verbs = 0 and n >= 2").select(F.lit("maybe route object").alias("kind"), "name", "n", "files", "origin"))
    out = out.unionByName(routed.where("verb").groupBy(F.col("last").alias("name")).agg(*seen).select(F.lit("route method").alias("kind"), "name", "n", "files", "origin"))
    out = out.unionByName(routed.where("verb").groupBy(F.col("file").alias("name")).agg(*seen).select(F.lit("door").alias("kind"), "name", "n", "files", "origin"))

    server = F.col("text").rlike(r"uvicorn\.run\(|\.run_forever\(|\.serve_forever\(")
    main = F.col("text").rlike(r"__name__ == [\"']__main__[\"']")
    starts = sources.where(F.col("file").endswith(".py") & ~_auxiliary("file")).select("file", F.when(server, "server").when(main, "main").alias("why")).where("why is not null")
    return out.unionByName(starts.select(F.concat(F.lit("entry: "), "why").alias("kind"), F.col("file").alias("name"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("files"), F.col("file").alias("origin")))


def starter(found: DataFrame, name: str = "main", most: int = 40) -> str:
    """A first configuration; each line says where it comes from, and maybes are commented out."""
    rows = sorted(found.orderBy(F.desc("n"), "kind", "name").limit(most).collect(), key=lambda r: (r.kind, -r.n, r.name))
    of = lambda *kinds: [r for r in rows if r.kind in kinds]
    quote = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = ["[project]", f"name = {quote(name)}", f"root = {quote(next((r.name for r in of('source root')), '.'))}", "", "[roots]"]
    for key, kinds in (("decorators", ("decorator",)), ("route_objects", ("route object",)), ("route_methods", ("route method",)), ("entries", ("entry: server", "entry: main"))):
        out += [f"{key} = [", *(f"  {quote(r.name)},  # {r.n} in {r.files}, first in {r.origin}" for r in of(*kinds)), "]"]
    out += [f"# maybe: {r.name} ({r.n}, only {r.origin})" for r in of("maybe decorator", "maybe route object")]
    out += ["", "[exclude]", f"patterns = [{', '.join(quote('(^|/)' + r.name + '/') for r in of('test folder', 'auxiliary folder', 'scratch folder'))}]"]
    return "\n".join(out) + "\n"
