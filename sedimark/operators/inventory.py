"""File inventory: walking order, exclusions, signatures, classification of files by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.ordered import range_index
from sedimark.functions.text import posix

#: Directories a walk leaves out, beside hidden ones.
EXCLUDED_DIRS = (
    ".git", ".gradle", ".hg", ".idea", ".mvn", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".svn", ".venv", ".vscode", "__pycache__",
    "bin", "build", "coverage", "dist", "env", "node_modules", "obj", "out", "target", "vendor", "venv",
)
#: Extensions and names that grouping leaves out.
EXCLUDED_EXTS = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".bmp", ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar", ".jar", ".war", ".class",
    ".so", ".dll", ".dylib", ".exe", ".bin", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".mov", ".avi", ".lock",
)
EXCLUDED_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "poetry.lock", "Cargo.lock", "composer.lock")
#: Names of configuration, build and logging files, and hints of migrations and deployments.
CONFIG_NAME = r"^(application(-[\w.-]+)?\.(ya?ml|properties)|bootstrap(-[\w.-]+)?\.(ya?ml|properties)|gradle\.properties|gradle-wrapper\.properties|build\.properties)$"
LOGGING_NAMES = ("logback.xml", "logback-spring.xml", "log4j2.xml", "log4j2-spring.xml")
DEPLOY_DIRS = ("k8s", "helm", "charts", "deploy", "deployment", ".github")
CATEGORIES = ("java", "config", "deployment", "other_relevant")
#: Extensions of structured text, and characters a token.
DENSE_EXTS = (".yml", ".yaml", ".json", ".properties", ".xml", ".toml")
CHARS_PER_TOKEN, CHARS_PER_TOKEN_DENSE = 4, 3


def with_path(files: DataFrame) -> DataFrame:
    """`files` with path (rel_path with /), base (file name) and suffix (extension as written, with its dot; empty without)."""
    path = posix(F.col("rel_path"))
    base = F.element_at(F.split(path, "/"), -1)
    return files.withColumns({"path": path, "base": base, "suffix": F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)})


def directories(path: Column) -> Column:
    """The directories of a path, top first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def walked(files: DataFrame, gitignore: list[str] | None = None) -> DataFrame:
    """A1-A3: files whose directories are neither hidden nor excluded, and which no gitignore pattern names; of several patterns the last decides."""
    rows = with_path(files)
    dirs = directories(F.col("path"))
    out = rows.where(~F.arrays_overlap(dirs, F.array(*map(F.lit, EXCLUDED_DIRS))) & ~F.exists(dirs, lambda d: d.startswith(".")))
    ignored = F.lit(False)
    for rule, negated in [gitwild(p) for p in gitignore or [] if p.strip() and not p.startswith("#")]:
        ignored = F.when(F.col("path").rlike(rule), F.lit(not negated)).otherwise(ignored)
    return out.where(~ignored)


def gitwild(pattern: str) -> tuple[str, bool]:
    """A gitignore pattern as (regular expression, negated)."""
    negated, p = pattern.startswith("!"), pattern.lstrip("!").rstrip()
    tail = "/.*" if p.endswith("/") else "(/.*)?"
    p = p.rstrip("/")
    anchored = "/" in p
    body = re.sub(r"\\\*\\\*/", "(.*/)?", re.escape(p.lstrip("/")))
    body = body.replace(r"/\*\*", "/.*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(^|/)") + body + tail + "$", negated


def walk_key(path: Column) -> Column:
    """A4: sorts files before sub-directories at every level, both by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda x, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), x))


def groupable(files: DataFrame) -> DataFrame:
    """A5: walked files without the extensions and names that grouping leaves out."""
    return walked(files).where(~F.lower("suffix").isin(*EXCLUDED_EXTS) & ~F.col("base").isin(*EXCLUDED_FILES))


def walk_order(files: DataFrame) -> DataFrame:
    """(repo, path, pos): the place of each distinct file in its repo's walk; ordered in ranges of even size, however large one directory is."""
    rows = groupable(files).select("repo", "path").distinct().withColumn("key", walk_key(F.col("path")))
    return range_index(rows, ["repo"], ["key"], "pos").select("repo", "path", "pos")


def signatures(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, sha256): hash of the content; files without content have none."""
    return with_path(files).where("content is not null").select("file_id", "repo", "path", F.sha2("content", 256).alias("sha256"))


def scan_context(files: DataFrame) -> DataFrame:
    """Per repo, Java and other files of the walk, and how many have a signature."""
    java = F.col("path").endswith(".java")
    return walked(files).groupBy("repo").agg(F.count_if(java).alias("n_java"), F.count_if(~java).alias("n_other"), F.count("content").alias("n_signed"))


def classified(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, category, bucket, found): the first class that fits a file's name; Java files count as java.

    Files of no class have null everywhere.
    """
    rows = walked(files)
    name, path, suffix = F.col("base"), F.col("path"), F.col("suffix")
    tests = [
        (path.endswith(".java"), "java", None, None),
        (name.rlike(CONFIG_NAME), "config", "configuration", "config file"),
        (name == "libs.versions.toml", "deployment", "deployment", "version catalog"),
        (name.isin("pom.xml", "build.xml") | suffix.isin(".gradle", ".groovy") | name.endswith(".gradle.kts"), "deployment", "deployment", "build script"),
        (name.isin(*LOGGING_NAMES), "other_relevant", "observability", "logging config file"),
        (name.startswith("Dockerfile") | name.rlike(r"^docker-compose.*\.ya?ml$"), "deployment", "deployment", "container/compose file"),
        (suffix.isin(".yml", ".yaml") & F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, DEPLOY_DIRS))), "deployment", "deployment", "deployment manifest"),
        (path.contains("db/migration") | path.contains("db/changelog") | path.contains("migrations"), "other_relevant", "persistence", "migration script"),
    ]

    def chain(k: int) -> Column:
        out = F.when(tests[0][0], F.lit(tests[0][k]).cast("string"))
        for t in tests[1:]:
            out = out.when(t[0], F.lit(t[k]).cast("string"))
        return out

    return rows.select("file_id", "repo", "path", chain(1).alias("category"), chain(2).alias("bucket"), chain(3).alias("found"))


def category_counts(files: DataFrame) -> DataFrame:
    """(repo, category, n): files scanned by category, every category of every repo, with 0 where there is none."""
    rows = classified(files)
    counts = [F.struct(F.lit(c).alias("category"), F.count_if(F.col("category") == c).alias("n")) for c in CATEGORIES]
    return rows.groupBy("repo").agg(F.array(*counts).alias("c")).select("repo", F.explode("c").alias("c")).select("repo", "c.category", "c.n")


def tokens_of(files: DataFrame) -> DataFrame:
    """(repo, path, tokens): characters over 3 in structured files and 4 in others, at least 1; binary and missing contents are left out.

    A path that came more than once counts with the text of its greatest file_id.
    """
    dense = F.lower("suffix").isin(*DENSE_EXTS)
    rows = groupable(files).where("content is not null and instr(substring(content, 1, 8000), '\\0') = 0")
    tokens = F.greatest(F.lit(1), F.floor(F.length("content") / F.when(dense, CHARS_PER_TOKEN_DENSE).otherwise(CHARS_PER_TOKEN))).cast("long")
    return rows.groupBy("repo", "path").agg(F.max_by(tokens, "file_id").alias("tokens"))
