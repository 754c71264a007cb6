"""Scalar column functions: names, paths, normalisers, symbols, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def posix(path: Column) -> Column:
    """A path with forward slashes and no white space around it."""
    return F.trim(F.regexp_replace(path, r"\\", "/"))


def snake_case(name: Column) -> Column:
    """Default table naming: an underscore between lower, Upper and lower letters, dots as underscores (H1)."""
    return F.lower(F.regexp_replace(F.replace(name, F.lit("."), F.lit("_")), r"(?<=[a-z])(?=[A-Z][a-z])", "_"))


def first_line(text: Column, limit: int = 200) -> Column:
    """The first line, trimmed, of at most `limit` characters: the identity of a citation."""
    return F.substring(F.regexp_replace(F.split(text, r"\r?\n")[0], r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), 1, limit)


def collapse_blanks(text: Column) -> Column:
    """White space runs as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_key(text: Column) -> Column:
    """Words and signs joined by a unit separator, comments left out: a key that ignores formatting only."""
    bare = F.regexp_replace(text, r"//[^\n]*|/\*[^*]*\*+([^/*][^*]*\*+)*/", " ")
    return F.array_join(F.regexp_extract_all(bare, F.lit(r'("[^"]*"|[A-Za-z0-9_$]+|[^\sA-Za-z0-9_$])'), 1), "\x1f")


def java_package(text: Column) -> Column:
    """The package a text declares; empty without one (H2)."""
    return F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)


def fqcn(package: Column, name: Column) -> Column:
    """Qualified class name; the plain name without a package."""
    return F.when(F.coalesce(package, F.lit("")) == "", name).otherwise(F.concat_ws(".", package, name))


def type_symbol(package: Column, name: Column, scheme: str = "code spring . ") -> Column:
    """The claim symbol of a type: scheme, namespaces as ns/, type with # (H3). Null for a name that is no identifier."""
    spaces = F.when(F.coalesce(package, F.lit("")) == "", "").otherwise(F.concat(F.replace(package, F.lit("."), F.lit("/")), F.lit("/")))
    return F.when(name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.concat(F.lit(scheme), spaces, name, F.lit("#")))


def parse_symbol(symbol: Column) -> Column:
    """(kind, namespaces, type_names, member) of a claim symbol; null if it isn't one (H4)."""
    body = F.regexp_extract(symbol, r"^\S+ \S+ \. (.+)$", 1)
    path = F.split(F.regexp_extract(body, r"^((?:[^/#]+/)*)", 1), "/")
    rest = F.regexp_extract(body, r"^(?:[^/#]+/)*(.+)$", 1)
    types = F.filter(F.split(F.regexp_extract(rest, r"^((?:\w+#)+)", 1), "#"), lambda x: x != "")
    tail = F.regexp_extract(rest, r"^(?:\w+#)+(.*)$", 1)
    kind = F.when(tail == "", "type").when(tail.rlike(r"^\w+\(\)\.$"), "method").when(tail.rlike(r"^\w+\.$"), "field")
    return F.when(
        kind.isNotNull() & (F.size(types) > 0),
        F.struct(kind.alias("kind"), F.filter(path, lambda x: x != "").alias("namespaces"), types.alias("type_names"), F.when(tail != "", F.regexp_extract(tail, r"^(\w+)", 1)).alias("member")),
    )


def source_set(path: Column) -> Column:
    """main or test for src/<set>/java files that aren't build results; null otherwise."""
    found = F.regexp_extract(path, r"(?:^|/)src/(main|test)/java/", 1)
    return F.when((found != "") & ~path.rlike(r"(^|/)(build|target|generated|generated-sources)/"), found)


def bucket_of(rule_id: Column) -> Column:
    """The evidence bucket that a rule id begins with."""
    return F.split_part(rule_id, F.lit("__"), F.lit(1))


def normal_route(path: Column) -> Column:
    """A route with plain {variables}, one leading slash, no double or trailing ones."""
    p = F.regexp_replace(path, r"\{([^}:]+):[^}]*\}", "{$1}")
    p = F.regexp_replace(F.concat(F.lit("/"), p), "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def bind_params(sql: Column) -> Column:
    """SQL with named and positional parameters as 1; casts like x::text stay (H5)."""
    return F.regexp_replace(F.regexp_replace(sql, r"(?<![\w'\":]):(\w+)", "1"), r"\?\d*", "1")


def rate(num: Column, den: Column) -> Column:
    """num / den; null, never 0, where there is nothing to count."""
    return F.when(den > 0, num.cast("double") / den)


def pseudonym(kind: str, name: Column, salt: str) -> Column:
    """kind_ and the first 12 hexadecimal digits of the salted name's hash."""
    return F.concat(F.lit(kind + "_"), F.left(F.sha2(F.concat(F.lit(salt), name), 256), F.lit(12)))
