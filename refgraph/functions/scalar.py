"""Column expressions that several operators share (C14, 2.12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subtokens(name: Column | str) -> Column:
    """C14: lower-case pieces of snake and camel case longer than two letters."""
    pieces = F.regexp_extract_all(name, F.lit(r"([0-9]+|[A-Z]{2,}(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+)"))
    return F.filter(F.transform(pieces, lambda x: F.lower(x)), lambda x: F.length(x) > 2)


def default_module(file: Column | str) -> Column:
    """1.3: first two path segments, or the first if there are no three."""
    parts = F.split(file, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def root_reason(decorator: Column | str) -> Column:
    """2.8: why a decorator makes a root: a route, a handler, itself, or null."""
    c = F.col(decorator) if isinstance(decorator, str) else decorator
    method = F.substring_index(c, ".", -1)
    known = F.substring_index(c, ".", 1).rlike("^(app|api|router|.*_router)$")
    return F.when(~c.contains("."), F.when(c.isin("tool", "task", "command", "fixture"), c)).when(known & method.isin("get", "post", "put", "delete", "patch", "head", "options"), "http_route").when(known, "protocol_handler")
