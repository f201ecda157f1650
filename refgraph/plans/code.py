"""Queries over source texts written here (golden), line classification, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refgraph.functions.scalar import root_reason, subtokens
from refgraph.operators import joins, layout
from refgraph.plans import bindings as b
from refgraph.plans.registry import Tables, query
from refgraph.sources import bootstrap, code

_MAIN = '''from lib import work as w, unique_helper

router = Router(prefix="/items")

@router.get("/{id}")
def show(id):
    work = id
    if id:
        w(id)
    else:
        unique_helper()
    return work

@tool
def run():
    total = [unique_helper for unique_helper in (1, 2)]
    return total
'''
_LIB = '''def work(x):
    try:
        a = x
        b = a + 1
        c = b * 2
    except ValueError:
        a = 0
        b = 1
        c = a + b
    return c

def unique_helper():
    def nested(y):
        return y
    for i in range(3):
        nested(i)

class Box:
    def keep(self):
        try:
            q = 5
            r = q + 7
            s = r * 9
        except KeyError:
            q = 8
            r = 9
            s = q + r
        return self.work
'''
SOURCES = [("demo", "main.py", _MAIN), ("demo", "lib.py", _LIB), ("demo", "broken.py", "def (")]


def _sources(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(SOURCES, "project string, file string, text string")


def _golden(columns: str, *rows: tuple) -> str:
    def one(x: object) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else repr(x)

    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


@query(_golden('file, line, "end", name, kind', ("main.py", 6, 12, "show", "function"), ("main.py", 15, 17, "run", "function"), ("lib.py", 1, 10, "work", "function"), ("lib.py", 12, 16, "unique_helper", "function"), ("lib.py", 13, 14, "nested", "function"), ("lib.py", 18, 28, "Box", "class"), ("lib.py", 19, 28, "keep", "function")))
def code_symbols(t: Tables):
    """Golden."""
    return code.facts(_sources(t)).where("kind = 'symbol'").select("file", "line", "end", "name", F.col("detail").alias("kind"))


@query(_golden("name, bound", ("show", "id"), ("show", "work"), ("run", "total"), ("run", "unique_helper"), ("work", "x"), ("work", "a"), ("work", "b"), ("work", "c"), ("unique_helper", "i"), ("nested", "i"), ("nested", "y"), ("keep", "self"), ("keep", "q"), ("keep", "r"), ("keep", "s")))
def code_scope(t: Tables):
    """Golden; a nested function inherits."""
    return code.facts(_sources(t)).where("kind = 'bound'").select("name", F.col("detail").alias("bound"))


@query(_golden("owner, target, strong, weight", ("lib.py:12:unique_helper", "lib.py:13:nested", True, 1.0), ("lib.py:19:keep", "lib.py:1:work", True, 0.25), ("main.py", "lib.py:1:work", True, 1.0), ("main.py", "lib.py:12:unique_helper", True, 1.0), ("main.py:6:show", "lib.py:1:work", True, 1.0), ("main.py:6:show", "lib.py:12:unique_helper", True, 1.0)))
def code_refs(t: Tables):
    """Golden; the alias resolves, the shadowed and the throwaway name don't."""
    return code.project_graph(code.facts(_sources(t)))["refs"].select("owner", F.col("id").alias("target"), "strong", "weight")


_RULES = [("demo", "a.py", "def replace(x):\n    return x\n\ndef own(x):\n    return x\n"), ("demo", "b.py", "text = ' '.replace(1)\ndef one(s):\n    return s.replace(2)\ndef two(s):\n    return replace(s)\ndef three(s):\n    return s.own(3)\n")]


@query(_golden("owner, target, strong", ("b.py", "a.py:1:replace", True), ("b.py:2:one", "a.py:1:replace", False), ("b.py:4:two", "a.py:1:replace", True), ("b.py:6:three", "a.py:4:own", True)))
def code_strong_rule(t: Tables):
    """Golden; an attribute named like a method of a built-in type is weak, but not where a module itself refers to it."""
    sources = t.spark.createDataFrame(_RULES, "project string, file string, text string")
    return code.project_graph(code.facts(sources))["refs"].select("owner", F.col("id").alias("target"), "strong")


@query(_golden("file, line, cond, branch", ("main.py", 9, "8", "then"), ("main.py", 11, "8", "else")))
def code_branches(t: Tables):
    """Golden; loops are no alternatives."""
    return code.facts(_sources(t)).where("kind = 'branch'").select("file", "line", F.col("name").alias("cond"), F.col("detail").alias("branch"))


@query(_golden("members, size", ("keep/except work/except", 2)))
def code_blocks(t: Tables):
    """Golden; blocks of one shape, whatever their names and literals."""
    f = code.facts(_sources(t)).where("kind = 'fragment'").groupBy("detail").agg(F.array_sort(F.collect_list("name")).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return f.select(F.concat_ws(" ", "m").alias("members"), "size")


@query(_golden("file, line, path", ("main.py", 6, "/items/{id}")))
def code_seams(t: Tables):
    """Golden; the route carries its router's prefix."""
    return code.routes(code.facts(_sources(t))).select("file", "line", "path")


_CHAIN = [
    ("back", "api_router.py", 'from routers import ops as ops_module\nfrom routers.docs import router as docs_router\nv1 = APIRouter(prefix="/api/v1")\nv1.include_router(docs_router, prefix="/docs")\nv1.include_router(ops_module.router, prefix="/ops")\n'),
    ("back", "routers/__init__.py", ""),
    ("back", "routers/docs.py", 'router = APIRouter(prefix="/d")\n@router.get("/{id}")\ndef one(id):\n    return store.table("documents")\n@tool(name="find_document")\ndef find():\n    return db.rpc("search")\n'),
    ("back", "routers/ops.py", 'from .deep import sub\nrouter = APIRouter()\nrouter.include_router(sub, prefix="/deep")\n@router.post("/run")\ndef run():\n    pass\n'),
    ("back", "routers/deep.py", 'sub = APIRouter(prefix="/s")\n@sub.get("/x")\ndef x():\n    pass\n'),
    ("back", "routers/alone.py", 'router = APIRouter(prefix="/alone")\n@router.get("")\ndef alone():\n    pass\n'),
    ("back", "loop.py", 'a = APIRouter(prefix="/a")\nb = APIRouter(prefix="/b")\na.include_router(b)\nb.include_router(a)\n@a.get("/y")\ndef y():\n    pass\n'),
    ("front", "page.py", 'def go(c):\n    c.post("/api/v1/ops/run")\n    again = "/api/v1/ops/run"\n    ask("find_document")\n    c.get("/api/v1/other")\n'),
]


def _chain(t: Tables) -> DataFrame:
    return code.facts(t.spark.createDataFrame(_CHAIN, "project string, file string, text string"))


@query(_golden("file, path", ("routers/docs.py", "/api/v1/docs/d/{id}"), ("routers/ops.py", "/api/v1/ops/run"), ("routers/deep.py", "/api/v1/ops/deep/s/x"), ("routers/alone.py", "/alone"), ("loop.py", "/a/y")))
def code_route_chain(t: Tables):
    """Golden; prefixes through three files, relative imports, a router on its own, and two that include each other."""
    return code.routes(_chain(t)).select("file", "path")


_FOLDER = [
    ("p", "src/main.py", 'if __name__ == "__main__":\n    go()\n'), ("p", "src/api/a.py", '@router.get("/a")\ndef a():\n    pass\n@tool\ndef t():\n    pass\n'), ("p", "src/api/b.py", '@router.post("/b")\ndef b():\n    pass\n@tool\ndef u():\n    pass\n@once\ndef v():\n    pass\n'),
    ("p", "tests/test_a.py", '@fixture\ndef f():\n    pass\nif __name__ == "__main__":\n    pass\n'), ("p", "scripts/run.py", "import uvicorn\nuvicorn.run(1)\n"), ("p", "src/server.py", "uvicorn.run(app)\n"),
]


@query(_golden("kind, name, n, files, origin", ("source root", "src", 4, 4, "src/api/a.py"), ("test folder", "tests", 1, 1, "tests/test_a.py"), ("auxiliary folder", "scripts", 1, 1, "scripts/run.py"), ("decorator", "tool", 2, 2, "src/api/a.py"), ("maybe decorator", "once", 1, 1, "src/api/b.py"), ("route object", "router", 2, 2, "src/api/a.py"), ("route method", "get", 1, 1, "src/api/a.py"), ("route method", "post", 1, 1, "src/api/b.py"), ("door", "src/api/a.py", 1, 1, "src/api/a.py"), ("door", "src/api/b.py", 1, 1, "src/api/b.py"), ("entry: main", "src/main.py", 1, 1, "src/main.py"), ("entry: server", "src/server.py", 1, 1, "src/server.py")))
def project_bootstrap(t: Tables):
    """A10: golden; what a project's files say about how it starts."""
    sources = t.spark.createDataFrame(_FOLDER, "project string, file string, text string")
    return bootstrap.detected(sources, code.facts(sources))


_BY = code.Selectors(routers=("router", "sub"), patterns=("find_[a-z]+",))
_SEAMS = [
    ("back", "exports", "tool", "find_document", "routers/docs.py"), ("back", "exports", "path", "/api/v1/docs/d/{id}", "routers/docs.py"), ("back", "exports", "path", "/api/v1/ops/run", "routers/ops.py"), ("back", "exports", "path", "/api/v1/ops/deep/s/x", "routers/deep.py"), ("back", "exports", "path", "/alone", "routers/alone.py"),
    ("back", "touches", "table", "documents", "routers/docs.py"), ("back", "touches", "rpc", "search", "routers/docs.py"), ("front", "consumes", "path", "/api/v1/ops/run", "page.py"), ("front", "consumes", "path", "/api/v1/other", "page.py"), ("front", "consumes", "tool", "find_document", "page.py"),
]


@query(_golden("project, side, kind, literal, file", *_SEAMS))
def code_seam_literals(t: Tables):
    """Golden; tools by name, routes with prefixes, tables and calls, constants by beginning and pattern."""
    found = code.seams(_chain(t), _BY).select("project", "side", "kind", "literal", "file").distinct()
    return found.where("not (project = 'back' and side = 'consumes')")  # the router's own prefix and the tool's own name are constants too


@query(_golden("consumer, provider, kind, literal, uses", ("front", "back", "path", "/api/v1/ops/run", 2), ("front", "back", "tool", "find_document", 1)))
def code_weave(t: Tables):
    """Golden; projects meet on seams taken from their sources."""
    s = code.seams(_chain(t), _BY)
    return joins.across_projects(s.where("side = 'consumes'").select("project", "kind", "literal"), s.where("side <> 'consumes'").select("project", "kind", "literal"))


@query(_golden("name, decorator, reason", ("show", "router.get", "http_route"), ("run", "tool", "tool")))
def code_roots(t: Tables):
    """Golden."""
    d = code.facts(_sources(t)).where("kind = 'decorator'")
    return d.select("name", F.col("detail").alias("decorator"), root_reason("detail").alias("reason"))


@query(_golden("name, tokens", ("unique_helper", "unique helper"), ("nested", "nested"), ("show", "show"), ("run", "run"), ("work", "work"), ("Box", "box"), ("keep", "keep")))
def code_subtokens(t: Tables):
    """C14: golden."""
    return code.facts(_sources(t)).where("kind = 'symbol'").select("name", F.concat_ws(" ", subtokens("name")).alias("tokens"))


_LINES = [("a.py", "from lib import helper"), ("a.py", "x = helper(1)"), ("b.py", "# helper was here"), ("c.py", 's = "helper"'), ("d.md", "call helper first"), ("e.py", "def helper(x):"), ("f.py", "unrelated = 1"), ("g.pyi", "def helper(x: int) -> int: ...")]


@query(_golden("kind, lines, verdict", ("code", 2, "alive"), ("comment", 1, "alive"), ("string", 1, "alive"), ("doc", 1, "alive"), ("definition", 1, "alive"), ("declaration", 1, "alive")))
def dead_match_classify(t: Tables):
    """Golden; each line with the name is classed, and any use in code keeps the candidate."""
    lines = t.spark.createDataFrame(_LINES, "file string, line string").where(F.col("line").rlike(r"\bhelper\b"))
    before = F.regexp_extract("line", r"^(.*?)\bhelper\b", 1)
    kind = (
        F.when(F.col("file").endswith(".md"), "doc").when(F.col("file").endswith(".pyi"), "declaration").when(F.trim("line").startswith("#"), "comment")
        .when(F.col("line").rlike(r"^\s*(class|def|async +def) +helper\b"), "definition")
        .when((F.length(F.regexp_replace(before, "[^\"']", "")) % 2) == 1, "string").otherwise("code")
    )
    each = lines.withColumn("kind", kind).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"))
    alive = F.max(F.col("kind") == "code").over(Window.partitionBy(F.lit(1)))  # at most six rows
    return each.select("kind", "lines", F.when(alive, "alive").otherwise("dead").alias("verdict"))


def _module_edges(t: Tables) -> DataFrame:
    p = b.parts(t)
    e = b.returned(t).join(p.select(F.col("id").alias("src"), F.col("module").alias("a")), "src").join(p.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst")
    return e.where("a <> b and strong").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("w"))


@query()
def layers_bounded(t: Tables):
    """Layers of the modules; the roll-up is distributed, its handful of rows is laid out on the driver."""
    return t.spark.createDataFrame([(n, layer) for n, (layer, _) in layout.placed(_module_edges(t)).items()], "module string, layer int")


@query()
def barycenter(t: Tables):
    """columns of the modules inside their layers."""
    return t.spark.createDataFrame([(n, layer, column) for n, (layer, column) in layout.placed(_module_edges(t)).items()], "module string, layer int, position int")
