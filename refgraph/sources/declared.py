"""What is declared or recorded outside the sources: configuration, commits, coverage records, clone index, sinks."""

from __future__ import annotations

import io
import subprocess
import tarfile
import tomllib
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refgraph.operators import similarity


@dataclass(frozen=True)
class Config:
    """A3: what a project declares; groups keep the order of their declaration, which decides ties."""

    name: str = "main"
    folder: str = "."
    shipped: tuple[str, ...] = ()
    entered: tuple[str, ...] = ()
    skipped: tuple[str, ...] = ()
    modules: tuple[tuple[str, str], ...] = ()
    contracts: tuple[dict, ...] = field(default=())
    areas: tuple[tuple[str, str], ...] = ()
    alike: float = 0.8
    least: tuple[int, int] = (4, 3)

    def groups(self, spark: SparkSession, kind: str = "modules") -> DataFrame:
        rows = [(n, p, i) for i, (n, p) in enumerate(getattr(self, kind))]
        return spark.createDataFrame(rows, "name string, prefix string, ordinal int")


def load(path: str) -> Config:
    raw = tomllib.loads(Path(path).read_text())
    project, roots, dup = raw.get("project", {}), raw.get("roots", {}), raw.get("duplicates", {})
    flat = lambda d: tuple((n, p) for n, ps in d.items() for p in ([ps] if isinstance(ps, str) else ps))
    return Config(
        name=project.get("name", "main"), folder=project.get("root", "."), shipped=tuple(roots.get("product_dirs", ())), entered=tuple(roots.get("dirs", ())), skipped=tuple(raw.get("exclude", {}).get("patterns", ())),
        modules=flat(raw.get("modules", {})), areas=flat(raw.get("areas", {})), contracts=tuple(raw.get("locks", ())), alike=dup.get("jaccard_threshold", 0.8), least=(dup.get("min_statements", 4), dup.get("min_statements_block", 3)),
    )


def discover(start: str, name: str) -> str | None:
    """A3: the nearest file of that name at or above ``start``."""
    at = Path(start).resolve()
    return next((str(p / name) for p in (at, *at.parents) if (p / name).is_file()), None)


def commits(spark: SparkSession, repository: str, last: int = 400) -> DataFrame:
    """A5: commits(sha, file) of the last so many commits."""
    done = subprocess.run(["git", "-C", repository, "log", f"-{last}", "--name-only", "--format=%x01%H"], capture_output=True, text=True, check=True)
    rows = [(head, f) for block in done.stdout.split("\x01")[1:] for head, *files in [block.split("\n")] for f in files if f]
    return spark.createDataFrame(rows, "sha string, file string")


def snapshot(spark: SparkSession, repository: str, ref: str, suffix: str = ".py") -> DataFrame:
    """sources(project, file, text) at a commit; one archive holds all of them."""
    packed = subprocess.run(["git", "-C", repository, "archive", "--format=tar", ref], capture_output=True, check=True).stdout
    with tarfile.open(fileobj=io.BytesIO(packed)) as tar:
        rows = [(ref, m.name, tar.extractfile(m).read().decode(errors="replace")) for m in tar if m.isfile() and m.name.endswith(suffix)]
    return spark.createDataFrame(rows, "project string, file string, text string")


def walkthrough(path: str) -> dict[str, tuple[dict, ...]]:
    """Lanes, stages and cuts of a walkthrough, in the order of their declaration."""
    raw = tomllib.loads(Path(path).read_text())
    return {k: tuple(raw.get(k, ())) for k in ("lane", "stage", "cut")}


def texts(spark: SparkSession, root: str, most: int = 2 << 20) -> DataFrame:
    """(path, text) of every file of at most ``most`` bytes that is UTF-8."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most)
    return found.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("text")).where("text is not null")


def clone_index(units: DataFrame) -> DataFrame:
    """clone_index(file, name, line, content_hash, shape_hash, signature) of units with a skeleton column."""
    return units.select("file", "name", "line", "content_hash", F.md5("skeleton").alias("shape_hash"), similarity.signature(F.col("skeleton")).alias("signature"))


def refreshed(old: DataFrame, units: DataFrame) -> DataFrame:
    """Rows of unchanged files are kept, those of changed or new ones made again, those of deleted ones dropped."""
    now = units.select("file", "content_hash").distinct()
    same = old.join(now, ["file", "content_hash"], "left_semi")
    changed = units.join(old.select("file", "content_hash").distinct(), ["file", "content_hash"], "left_anti")
    return same.select(old.columns).unionByName(clone_index(changed))


def written(index: DataFrame, folder: str) -> str:
    """Writes a new version beside the old ones and gives its path; readers of the old one aren't disturbed."""
    path = f"{folder.rstrip('/')}/version={uuid.uuid4()}"
    index.write.mode("errorifexists").parquet(path)
    return path


def gate(new: DataFrame, index: DataFrame, threshold: float = 0.75, most: int = 6) -> DataFrame:
    """Warnings (name, kind, file, found, jaccard) for new units, ``most`` of them; never more than advice.

    new(file, name, skeleton). Up to three homonyms elsewhere, then an equal shape, else the best sketch.
    """
    n = new.select("file", "name", F.md5("skeleton").alias("h"), similarity.signature(F.col("skeleton")).alias("s"))
    o = index.select(F.col("file").alias("other"), F.col("name").alias("found"), "line", "shape_hash", "signature")
    same = n.join(o, (n["name"] == o["found"]) & (n["file"] != o["other"])).withColumn("k", F.row_number().over(Window.partitionBy("file", "name").orderBy("other", "line"))).where("k <= 3")
    named = same.select("name", F.lit("name").alias("kind"), F.col("other").alias("file"), "found", F.lit(None).cast("double").alias("jaccard"))
    keys = n.select("file", "name", F.explode(F.array_append("s", F.col("h"))).alias("key")).join(o.select("other", "found", "line", F.explode(F.array_append("signature", F.col("shape_hash"))).alias("key")), "key")
    pairs = keys.where(F.col("file") != F.col("other")).select("file", "name", "other", "found", "line").distinct()
    both = pairs.join(n, ["file", "name"]).join(o, ["other", "found", "line"])
    j = both.withColumn("j", F.when(F.col("h") == F.col("shape_hash"), 1.0).otherwise(similarity.estimate(F.col("s"), F.col("signature")))).where(F.col("j") >= threshold)
    best = j.groupBy("file", "name").agg(F.min(F.struct((-F.col("j")).alias("m"), "other", "line", "found")).alias("x"))
    alike = best.select("name", F.when(F.col("x.m") == -1, "identical").otherwise("similar").alias("kind"), F.col("x.other").alias("file"), F.col("x.found").alias("found"), F.round(-F.col("x.m"), 2).alias("jaccard"))
    return named.unionByName(alike).orderBy(F.desc_nulls_last("jaccard"), "name", "file").limit(most)


def json_lines(result: DataFrame, caveat: str) -> DataFrame:
    """B1, B2: one JSON text for each row, each with the caveat of what it claims."""
    return result.select(F.to_json(F.struct("*", F.lit(caveat).alias("caveat"))).alias("json"))


def mermaid(edges: DataFrame, most: int = 200) -> str:
    """A diagram of the heaviest edges(src, dst, w); a picture has a bounded size by nature."""
    rows = edges.orderBy(F.desc("w"), "src", "dst").limit(most).collect()
    name = {x: f"n{i}" for i, x in enumerate(sorted({str(v) for r in rows for v in (r.src, r.dst)}))}
    label = lambda x: str(x).replace('"', "'")
    return "\n".join(["flowchart LR", *(f'  {i}["{label(x)}"]' for x, i in name.items()), *(f"  {name[str(r.src)]} -->|{r.w:g}| {name[str(r.dst)]}" for r in rows)])


def sequence_diagram(told: DataFrame, most: int = 200) -> str:
    """A sequence diagram of a told tree (path, depth, ordinal, id, repeats), in the order it is told."""
    rows = told.where("depth > 0").limit(10 * most).collect()
    place = {tuple(r.path): r.ordinal for r in told.limit(10 * most).collect()}
    rows.sort(key=lambda r: [place.get(tuple(r.path[: i + 1]), 0) for i in range(len(r.path))])
    shown = rows[:most]
    names = list(dict.fromkeys(str(x) for r in shown for x in r.path[-2:]))
    label = lambda x: str(x).replace('"', "'").replace(";", ",")
    out = ["sequenceDiagram", *(f"  participant p{i} as {label(n)}" for i, n in enumerate(names))]
    out += [f"  p{names.index(str(r.path[-2]))}->>p{names.index(str(r.path[-1]))}: {'again' if r.repeats else 'calls'}" for r in shown]
    return "\n".join(out + ([f"  Note over p0: {len(rows) - most} more"] if len(rows) > most else []))


def toml_locks(found: list[tuple[str, str, str, str]]) -> str:
    """Proposed contracts (source, sink, kind, guarantee) as configuration text."""
    esc = lambda x: x.replace("\\", "\\\\").replace('"', '\\"')
    return "\n".join(f'[[locks]]\nname = "{esc(s)} to {esc(d)}"\nfrom = "{esc(s)}"\nto = "{esc(d)}"\nkind = "{k}"\nguarantee = "{esc(g)}"\n' for s, d, k, g in found)
