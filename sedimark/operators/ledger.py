"""Facts and measures over evidence: repositories, mapped entities, rates by stratum, manifests, claims, comparisons of two arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.text import posix, rate, type_symbol
from sedimark.operators.inventory import walked, with_path

#: Base types of repositories, markers of open work, file types that are swept for them, build tools by priority.
REPOSITORY_ROOTS = "JpaRepository|CrudRepository|PagingAndSortingRepository|MongoRepository|ReactiveCrudRepository"
MARKERS = "TODO|FIXME|XXX|HACK"
SWEPT = (".java", ".kt", ".py", ".js", ".ts", ".sql", ".xml", ".yml", ".yaml", ".properties", ".gradle", ".md", ".txt", ".json", ".sh", ".toml")
BUILD_FILES = ("gradlew.bat", "gradlew", "build.gradle", "build.gradle.kts", "mvnw.cmd", "mvnw", "pom.xml")
BUILD_TOOLS = "gradlew|gradle|mvnw|mvn|bash|sh|cmd|powershell"
SHELL_SIGNS = r"[;&|<>`$\n\r]"
#: Stages of a run by the key of the preflight that predicts their dispatches.
STAGE_OF = {
    "stage1_file_summarizer": "file_summarize", "stage2_architect_segment": "architect", "stage2_architect_merge": "architect", "stage3_gap_analyzer": "gap_analysis_interview",
    "stage3_software_architect_and_testing": "architecture_testing_review", "stage4_doc_writer": "doc_writer",
}
#: Dispatches of the last stage.
LAST_FANOUT = 14


def is_java_source(path: Column) -> Column:
    """Whether a path names a Java source file."""
    return path.endswith(".java")


def repositories(files: DataFrame) -> DataFrame:
    """(file_id, repo, file, repository, entity, id_type) of interfaces that extend one of five base types with an entity and an id type.

    The first interface and the first base type of a file count.
    """
    base = rf"(?:{REPOSITORY_ROOTS})\s*<\s*([^,>]+?)\s*,\s*([^>]+?)\s*>"
    rows = with_path(files).where(is_java_source(F.col("path")) & F.col("content").rlike(base))
    part = lambda p, i: F.regexp_extract("content", p, i)
    return rows.select("file_id", "repo", F.col("path").alias("file"), F.nullif(part(r"\binterface\s+(\w+)", 1), F.lit("")).alias("repository"), part(base, 1).alias("entity"), part(base, 2).alias("id_type"))


def todo_sweep(files: DataFrame, cap: int = 200) -> DataFrame:
    """(repo, path, line, marker, text): the first `cap` lines with a marker of open work by repo, path and line; a top-k report."""
    rows = walked(files).where((F.lower("suffix").isin(*SWEPT) | (F.lower("base") == "dockerfile")) & F.col("content").rlike(rf"\b({MARKERS})\b"))
    lines = rows.select("repo", "path", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("at", "l"))
    marker = F.regexp_extract("l", rf"\b({MARKERS})\b", 1)
    found = lines.where(marker != "").select("repo", "path", (F.col("at") + 1).alias("line"), marker.alias("marker"), F.substring(F.trim("l"), 1, 200).alias("text")).distinct()
    return found.orderBy("repo", "path", "line").limit(cap)


def maps_to(found: DataFrame) -> DataFrame:
    """(repo, subject, object, file, status, table_name_source): one MAPS_TO fact for each class, or for each candidate of a contested one.

    `found`: entities. The subject is the claim symbol of the type; candidates are distinct (file, table); of a single class the
    only one there is.
    """
    each = found.groupBy("repo", "class_name", "file", "table").agg(F.min(F.struct("table_name_source", "package")).alias("x"))
    per = each.groupBy("repo", "class_name").agg(F.count("*").alias("n"))
    rows = each.alias("e").join(per.alias("p"), F.col("e.repo").eqNullSafe(F.col("p.repo")) & (F.col("e.class_name") == F.col("p.class_name")))
    return rows.select("e.repo", type_symbol(F.col("x.package"), F.col("e.class_name")).alias("subject"), F.col("table").alias("object"), "file", F.when(F.col("n") > 1, "contested").otherwise("single").alias("status"), F.col("x.table_name_source").alias("table_name_source"))


def merged_maps(entries: DataFrame) -> DataFrame:
    """(repo, class_name, src, file, table, status, n_candidates): entity maps of several sources (repo, class_name, src, file, table).

    The entry of the first source counts, of one source's the smallest file; a class is contested if its tables or files differ.
    """
    per = entries.groupBy("repo", "class_name").agg(F.min(F.struct("src", "file", "table")).alias("f"), F.count_distinct(F.coalesce("file", F.lit("")), F.coalesce("table", F.lit(""))).alias("n_candidates"))
    return per.select("repo", "class_name", "f.src", "f.file", "f.table", F.when(F.col("n_candidates") > 1, "contested").otherwise("single").alias("status"), "n_candidates")


def first_signatures(signatures: DataFrame) -> DataFrame:
    """(repo, path, sha256): of several signatures of a file the first by snapshot, load time and value that isn't null."""
    first = F.min(F.when(F.col("sha256").isNotNull(), F.struct("snapshot_no", "loaded_at", "sha256")))
    return signatures.groupBy("repo", "path").agg(first.alias("f")).select("repo", "path", F.col("f.sha256").alias("sha256"))


def summed(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts (by, n) of several sources added up."""
    return counts.groupBy(*by).agg(F.sum("n").alias("n"))


def provenance_recheck(results: DataFrame, queries: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """`results` (repo, evidence_id, status) with the status after a look at the entity that each query was resolved by.

    queries: (repo, evidence_id, entity); old and new: (repo, entity, table, status). Only results that are unchanged or confirmed move: to
    missing if the entity is gone, contested if it has become so, drifted if its table is another one.
    """
    met = results.join(queries, ["repo", "evidence_id"], "left").join(old.select("repo", "entity", F.col("table").alias("was")), ["repo", "entity"], "left")
    met = met.join(new.select("repo", "entity", F.col("table").alias("now"), F.col("status").alias("state")), ["repo", "entity"], "left")
    moved = F.when(F.col("state").isNull(), "missing").when(F.col("state") == "contested", "contested").when(~F.col("was").eqNullSafe(F.col("now")), "drifted")
    return met.select("repo", "evidence_id", "entity", F.when(F.col("entity").isNotNull() & F.col("status").isin("unchanged", "confirmed"), F.coalesce(moved, "status")).otherwise(F.col("status")).alias("status"))


def edge_sides(cut_: DataFrame, groups: DataFrame) -> DataFrame:
    """(repo, group_id, side, file, target, qualified, confidence): each cut arc as outbound of the groups of its file and inbound of
    those of its target."""
    g = groups.select("repo", "file", "group_id").distinct()
    out = cut_.join(g, ["repo", "file"]).withColumn("side", F.lit("outbound"))
    back = cut_.join(g.withColumnRenamed("file", "target"), ["repo", "target"]).withColumn("side", F.lit("inbound"))
    cols = ["repo", "group_id", "side", "file", "target", "qualified", "confidence"]
    return out.select(*cols).unionByName(back.select(*cols))


def edge_totals(resolved: DataFrame, cut_: DataFrame, sides: DataFrame, adjacent: DataFrame, groups: DataFrame, n_files: DataFrame) -> DataFrame:
    """Per repo, arcs cut by confidence, unresolved imports, rows shipped (sides and outside neighbours), rows that a broadcast of
    all files to all groups would ship, and their ratio (null if nothing is shipped)."""
    count = lambda c: F.count_if(F.col("confidence") == c).alias(c.replace("package-", ""))
    parts = [
        n_files, groups.groupBy("repo").agg(F.count_distinct("group_id").alias("n_groups")), cut_.groupBy("repo").agg(F.count("*").alias("cut_arcs"), count("exact"), count("package-fanout")),
        resolved.groupBy("repo").agg(F.count_if(F.col("confidence") == "unresolved").alias("unresolved")), sides.groupBy("repo").agg(F.count("*").alias("n_sides")),
        adjacent.groupBy("repo").agg(F.sum("n_outside").alias("n_adjacent")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "repo", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    shipped, broadcast = zero("n_sides") + zero("n_adjacent"), zero("n_files") * zero("n_groups")
    return out.select("repo", zero("cut_arcs").alias("cut_arcs"), zero("exact").alias("exact"), zero("fanout").alias("fanout"), zero("unresolved").alias("unresolved"), shipped.alias("rows_shipped"), broadcast.alias("broadcast_rows"), rate(broadcast, shipped).alias("reduction"))


def reason_class(reason: Column) -> Column:
    """H9: the class of a refusal."""
    low = F.lower(reason)
    return (
        F.when(F.coalesce(reason, F.lit("")) == "", "unavailable_unknown").when(reason.contains("InvalidSyntaxException") | low.contains("unparsable"), "dialect_or_syntax")
        .when(low.contains("contested"), "contested_refuse").when(low.contains("not found") | low.contains("no entity") | low.contains("unknown entity"), "entity_lookup").otherwise("unavailable_other")
    )


def clean_table(name: Column) -> Column:
    """H8: a table name without the marker of the default schema."""
    return F.regexp_replace(name, r"^<default>\.", "")


def lineage_strata(rows: DataFrame) -> DataFrame:
    """(repo, stratum, scoring, n, n_available, rate) of query rows (repo, query_kind, query, available), by stratum and in all.

    Scoring callable leaves rows without a query out of the total, and they are a stratum; scoring pooled counts them as failed native ones.
    """
    kind = F.when(F.col("query_kind").isin("native", "jpql"), F.col("query_kind")).otherwise("other")
    lost = F.col("query").isNull()
    modes = F.explode(F.array(F.struct(F.lit("callable").alias("scoring"), F.when(lost, "null_query").otherwise(kind).alias("stratum")), F.struct(F.lit("pooled").alias("scoring"), F.when(lost, "native").otherwise(kind).alias("stratum"))))
    each = rows.select("repo", modes.alias("m"), F.when(F.coalesce("available", F.lit(False)) & ~lost, 1).otherwise(0).alias("a"))
    per = each.groupBy("repo", F.col("m.scoring").alias("scoring"), F.col("m.stratum").alias("stratum")).agg(F.count("*").alias("n"), F.sum("a").alias("n_available"))
    total = per.where("stratum <> 'null_query'").groupBy("repo", "scoring").agg(F.sum("n").alias("n"), F.sum("n_available").alias("n_available")).withColumn("stratum", F.lit("all"))
    cols = ["repo", "scoring", "stratum", "n", "n_available"]
    return per.select(*cols).unionByName(total.select(*cols)).withColumn("rate", rate(F.col("n_available"), F.col("n")))


def failures(rows: DataFrame) -> DataFrame:
    """(repo, layer, stratum, reason_class, file, line, subject, locator) of query rows without lineage; locators keep empty parts."""
    lost = F.col("query").isNull()
    got = rows.where(lost | ~F.coalesce("available", F.lit(False)))
    stratum = F.when(lost, "null_query").when(F.col("query_kind").isin("native", "jpql"), F.col("query_kind")).otherwise("other")
    got = got.select("repo", F.lit("lineage").alias("layer"), stratum.alias("stratum"), F.when(lost, "null_query").otherwise(reason_class(F.col("reason"))).alias("reason_class"), "file", "line", F.lit(None).cast("string").alias("subject"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return got.withColumn("locator", F.concat_ws("|", *map(text, ("layer", "stratum", "reason_class", "file", "line", "subject"))))


def dominant(failed: DataFrame) -> DataFrame:
    """(repo, reason_class, n): the most frequent reason of a repo's failures, null queries aside unless there is nothing else; of
    equals the first of the alphabet."""
    per = failed.groupBy("repo", "reason_class").agg(F.count("*").alias("n")).withColumn("o", F.when(F.col("reason_class") == "null_query", 1).otherwise(0))
    top = F.row_number().over(Window.partitionBy("repo").orderBy("o", F.desc("n"), "reason_class"))
    return per.withColumn("k", top).where("k = 1").select("repo", "reason_class", "n")


def callable_trials(claims: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_callable, n_absent, n_unproven) of absence claims (by, family, predicate, witness)."""
    return claims.groupBy(*by).agg(F.count("witness").alias("n_callable"), F.count_if(F.col("predicate") == "ABSENCE").alias("n_absent"), F.count_if(F.col("predicate") == "UNPROVEN").alias("n_unproven"))


def interview_counts(answers: DataFrame, by: list[str]) -> DataFrame:
    """(by, asked, answered, skipped) of questions (by, status); rows without a status are left out."""
    rows = answers.where("status is not null")
    return rows.groupBy(*by).agg(F.count("*").alias("asked"), F.count_if(F.col("status") == "answered").alias("answered"), F.count_if(F.col("status") == "skipped").alias("skipped"))


def fanout(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """(stage, predicted, actual, verdict): dispatches predicted by key (key, n) against those of stages (stage, n); keys without a stage are unmapped."""
    keys = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    mapped = predicted.select(keys[F.col("key")].alias("stage"), "key", "n")
    sums = mapped.where("stage is not null").groupBy("stage").agg(F.sum("n").alias("predicted"))
    both = sums.join(actual.groupBy("stage").agg(F.sum("n").alias("actual")), "stage", "full_outer")
    verdict = F.when(F.col("predicted").isNull(), "not predicted").when(F.col("actual").isNull(), "not run").when(F.col("predicted") == F.col("actual"), "as predicted").otherwise("differs")
    lost = mapped.where("stage is null").select(F.col("key").alias("stage"), F.col("n").alias("predicted"), F.lit(None).cast("long").alias("actual"), F.lit("unmapped").alias("verdict"))
    return both.select("stage", "predicted", "actual", verdict.alias("verdict")).unionByName(lost)


def run_status(stages: DataFrame, by: str) -> DataFrame:
    """(by, status, n): failed if a stage failed, partial if one was canceled or never ended, else complete."""
    any_ = lambda *s: F.max(F.coalesce(F.lower("status").isin(*s), F.lit(False)))
    per = stages.groupBy(by).agg(any_("failed", "fail").alias("f"), any_("canceled", "running").alias("c"), F.count("*").alias("n"))
    return per.select(by, F.when(F.col("f"), "failed").when(F.col("c"), "partial").otherwise("complete").alias("status"), "n")


def pool_tokens(groups: DataFrame, signals: DataFrame) -> DataFrame:
    """(repo, proxy, measured, proxy_all, ratio): the last stage's shared input as the sum of its groups' tokens, against that of the
    signals (repo, tokens), times its dispatches; the ratio is null if nothing was measured."""
    a = groups.groupBy("repo").agg(F.sum("tokens").alias("proxy"))
    both = a.join(signals.groupBy("repo").agg(F.sum("tokens").alias("measured")), "repo", "left")
    return both.select("repo", "proxy", "measured", (F.col("proxy") * LAST_FANOUT).alias("proxy_all"), rate(F.col("measured"), F.col("proxy")).alias("ratio"))


def claim_metrics(claims: DataFrame) -> DataFrame:
    """(status, n, n_falsifiable, n_predicates, oldest) of claims (status, n_predicates, dated): by status, the most frequent first."""
    per = claims.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("n_predicates") > 0).alias("n_falsifiable"), F.sum("n_predicates").alias("n_predicates"), F.min("dated").alias("oldest"))
    return per.orderBy(F.desc("n"), "status")


def derived_counts(counts: dict[str, DataFrame]) -> DataFrame:
    """(name, n): a closed registry of scalar counts."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def arm_comparison(oracle: DataFrame, engine: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, cause): what an oracle (keys, cause) and an engine (keys) say: matched, missed with the cause, or false positive."""
    a = oracle.groupBy(*keys).agg(F.min("cause").alias("cause")).withColumn("a", F.lit(1)).alias("a")
    b = engine.select(*keys).distinct().withColumn("b", F.lit(1)).alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    pick = [F.when(F.col("a.a").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    verdict = F.when(F.col("b.b").isNull(), "missed").when(F.col("a.a").isNull(), "false positive").otherwise("matched")
    return met.select(*pick, verdict.alias("verdict"), F.when(verdict == "missed", F.col("a.cause")).alias("cause"))


def arm_summary(compared: DataFrame, by: str) -> DataFrame:
    """(by, oracle_total, matched, missed, false_positives, recall, precision) of a comparison."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    per = compared.groupBy(by).agg(n("matched").alias("matched"), n("missed").alias("missed"), n("false positive").alias("false_positives"))
    m, lost, wrong = F.col("matched"), F.col("missed"), F.col("false_positives")
    return per.select(by, (m + lost).alias("oracle_total"), m, lost, wrong, rate(m, m + lost).alias("recall"), rate(m, m + wrong).alias("precision"))


def recall_misses(oracle: DataFrame, native: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, subject, file, verdict): entities (repo, name) that only the oracle has, with their file where the map (repo, name, file) knows it; names in Impl that it doesn't are evidentiary."""
    lost = oracle.select("repo", "name").distinct().join(native.select("repo", "name").distinct(), ["repo", "name"], "left_anti")
    met = lost.join(known.groupBy("repo", "name").agg(F.min("file").alias("file")).withColumn("k", F.lit(1)), ["repo", "name"], "left")
    return met.select("repo", F.concat(F.lit("entity:"), "name").alias("subject"), "file", F.when(F.col("k").isNull() & F.col("name").endswith("Impl"), "EVIDENTIARY").otherwise("STRUCTURAL").alias("verdict"))


def writer_facts(verdicts: DataFrame, receipts: DataFrame, claims: DataFrame, misses: DataFrame) -> DataFrame:
    """(repo, predicate, subject, verdict): absence claims and recall misses of repos whose covering holds and whose astgrep receipt is complete."""
    sure = verdicts.where("ok").select("repo").join(receipts.where("scanner = 'astgrep' and status = 'complete'").select("repo").distinct(), "repo", "left_semi")
    a = claims.select("repo", "predicate", F.concat_ws(":", F.lit("family"), "module", "family").alias("subject"), F.lit(None).cast("string").alias("verdict"))
    b = misses.select("repo", F.lit("RECALL_MISS").alias("predicate"), "subject", "verdict")
    return a.unionByName(b).join(sure, "repo", "left_semi")


def build_command(files: DataFrame) -> DataFrame:
    """(repo, build_file, command): the first build file at the top of a repo (or of a module) by priority, and what runs it."""
    order = F.array_position(F.array(*map(F.lit, BUILD_FILES)), F.col("base"))
    rows = with_path(files).where(order > 0).groupBy("repo").agg(F.min(F.struct(F.size(F.split("path", "/")).alias("d"), order.alias("o"), "path")).alias("m"))
    name = F.element_at(F.array(*map(F.lit, BUILD_FILES)), F.col("m.o").cast("int"))
    tool = F.when(name.startswith("gradlew"), F.col("m.path")).when(name.startswith("build.gradle"), "gradle").when(name.startswith("mvnw"), F.col("m.path")).otherwise("mvn")
    goals = F.when(name.contains("gradle"), "--no-daemon clean compileJava compileTestJava").otherwise("--no-daemon clean compile test-compile")
    return rows.select("repo", name.alias("build_file"), F.concat(F.lit('"'), tool, F.lit('" '), goals).alias("command"))


def command_fault(command: Column) -> Column:
    """Why a build command is refused (empty, shell signs, unknown tool); null if it isn't."""
    first = F.lower(F.element_at(F.split(F.replace(F.regexp_extract(F.trim(command), r"^(\"[^\"]*\"|'[^']*'|\S+)", 1), F.lit("\\"), F.lit("/")), "/"), -1))
    return F.when(F.coalesce(F.trim(command), F.lit("")) == "", "empty").when(command.rlike(SHELL_SIGNS), "shell signs").when(~F.regexp_replace(first, "[\"']", "").rlike(rf"^({BUILD_TOOLS})"), "unknown tool")


def cache_keys(roots: DataFrame, commands: DataFrame, version: str) -> DataFrame:
    """(repo, key): a content key of roots (repo, root), build commands (repo, command; may be missing) and the version of the rules."""
    met = roots.join(commands.select("repo", "command"), "repo", "left")
    return met.select("repo", F.sha2(F.concat_ws("\0", "root", F.coalesce("command", F.lit("")), F.lit(version)), 256).alias("key"))


def union_tagged(tables: dict[str, DataFrame], tag: str = "query_file") -> DataFrame:
    """The rows of all tables with the name of their table; columns that one lacks are null. Columns are matched by name."""
    out = None
    for name, df in tables.items():
        rows = df.withColumn(tag, F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def decoded(results: DataFrame, columns: str, tuples: str) -> DataFrame:
    """`results` with row, a map of column to value for each tuple of a columnar result: `columns` is a JSON array of names, `tuples` one of arrays."""
    names, rows = F.from_json(columns, "array<string>"), F.from_json(tuples, "array<array<string>>")
    keep = [c for c in results.columns if c not in (columns, tuples)]
    each = results.select(*keep, names.alias("_n"), F.posexplode(rows).alias("nth", "_t"))
    return each.where(F.size("_n") == F.size("_t")).select(*keep, "nth", F.map_from_arrays("_n", "_t").alias("row"))


def line_range(text: Column, start: int, most: int) -> Column:
    """Up to `most` lines from line `start` (from 1); empty beyond the end."""
    return F.array_join(F.slice(F.split(F.regexp_replace(text, "\r", ""), "\n"), start, most), "\n")


def without_internal(df: DataFrame) -> DataFrame:
    """`df` without the columns that begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def adjacent(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """(group, value, next): each row's value with that of the row after it in its group."""
    after = F.lead(value).over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("next", after).where("next is not null").select(*group, value, "next")


def changed_paths(text: DataFrame) -> DataFrame:
    """(doc_id, state, path) of the lines of a porcelain status text (doc_id, text): two letters, a blank, a path, of renames the new one; quotes are left out."""
    lines = text.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(r"^[ MADRCU?!]{2} \S"))
    path = F.regexp_replace(F.regexp_replace(F.substring("l", 4, 1 << 20), r"^.* -> ", ""), r'^"|"$', "")
    return lines.select("doc_id", F.trim(F.substring("l", 1, 2)).alias("state"), path.alias("path"))


def out_of_scope(paths: DataFrame, allowed: list[str]) -> DataFrame:
    """paths outside of the directories that may be written."""
    return paths.where(~F.coalesce(F.col("path").rlike("^(" + "|".join(a.rstrip("/") + "(/|$)" for a in allowed) + ")"), F.lit(False)))


def perturbed(text: Column) -> dict[str, Column]:
    """Layouts of a Java text that change no token: a comment above the first annotation, doubled indents, a blank line more, and
    arguments of annotations on lines of their own."""
    return {
        "add_comment": F.regexp_replace(text, r"(?s)\A((?:.*?\n)??)([ \t]*)(@\w)", "$1$2// reviewed\n$2$3"),
        "reindent": F.regexp_replace(text, r"(?m)^([ \t]+)(?=\S)", "$1$1"),
        "blank_lines": F.regexp_replace(text, r"(?s)\A(.*?)\n\n(?!\n)", "$1\n\n\n"),
        "wrap_annotation_args": F.regexp_replace(text, r"(?m)^(?![^\n]*//)([ \t]*@\w+)\(([^()\n]+)\)[ \t]*$", "$1(\n        $2\n    )"),
    }


def http_method(match: Column) -> Column:
    """The verb of a mapping annotation; of a request mapping the one it names, else ANY."""
    word = F.upper(F.regexp_extract(match, r"(?i)@?(Get|Post|Put|Patch|Delete|Request)Mapping\b", 1))
    named = F.regexp_extract(match, r"(?i)method\s*[=:]\s*\{?\s*(?:RequestMethod\.)?(\w+)", 1)
    return F.when(word == "", F.lit(None).cast("string")).when(word != "REQUEST", word).when(named != "", F.upper(named)).otherwise("ANY")


def mapping_path(match: Column) -> Column:
    """The path of a mapping annotation: path or value by name, else the first literal; null without one."""
    named = F.regexp_extract(match, r"(?i)\b(?:path|value)\s*[=:]\s*\{?\s*[\"'`“”]([^\"'`“”]*)", 1)
    return F.nullif(F.when(named != "", named).otherwise(F.regexp_extract(match, r"\(\s*[\"'`“”]([^\"'`“”]*)", 1)), F.lit(""))


def value_key(match: Column) -> Column:
    """The key that a value annotation reads, its default left out."""
    return F.nullif(F.regexp_extract(match, r"\$\{([^:}]+)", 1), F.lit(""))


def python_checks(files: DataFrame) -> DataFrame:
    """(file_id, name, line, annotated, documented) of the functions of Python files that parse: whether all arguments (self and cls
    aside) and the result are annotated, and whether a public one has a doc string."""
    import ast
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for i, text in pdf.itertuples(index=False, name=None):
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for f in ast.walk(tree):
                    if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        args = [a for a in (*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs) if a.arg not in ("self", "cls")]
                        rows.append((i, f.name, f.lineno, f.returns is not None and all(a.annotation is not None for a in args), f.name.startswith("_") or ast.get_docstring(f) is not None))
            yield pd.DataFrame(rows, columns=["file_id", "name", "line", "annotated", "documented"])

    rows = with_path(files).where((F.lower("suffix") == ".py") & F.col("content").isNotNull()).select("file_id", "content")
    return rows.mapInPandas(run, "file_id bigint, name string, line int, annotated boolean, documented boolean")


def build_signals(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, version): what the extractor for each build file's name finds: plugins and dependencies of Gradle and
    Maven, versions and libraries of catalogues."""
    from sedimark.operators import evidence, verify

    text = lambda c: F.col(c).cast("string")
    g = evidence.gradle_dependencies(files).select("file_id", F.lit("dependency").alias("kind"), F.concat_ws(":", "group", F.nullif("name", F.lit(""))).alias("name"), "version")
    p = evidence.gradle_plugins(files).select("file_id", F.lit("plugin").alias("kind"), F.col("plugin_id").alias("name"), "version")
    m = verify.maven(files).select("file_id", "kind", F.concat_ws(":", "group", "name").alias("name"), "version")
    c = verify.version_catalog(files).select("file_id", "kind", F.col("key").alias("name"), text("value").alias("version"))
    return g.unionByName(p).unionByName(m).unionByName(c)


def declared_names(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(name, verdict): names in back ticks of prose (text) against those of code (name): in both, prose only or code only."""
    said = docs.where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"`([A-Za-z_]\w*)`"), 1)).alias("name")).distinct().withColumn("a", F.lit(1))
    both = said.join(known.select("name").where("name is not null").distinct().withColumn("b", F.lit(1)), "name", "full_outer")
    return both.select("name", F.when(F.col("b").isNull(), "prose only").when(F.col("a").isNull(), "code only").otherwise("both").alias("verdict"))


def static_faults(files: DataFrame) -> DataFrame:
    """(file_id, line, fault) in SQL files: an operator `or` or `and` with nothing after or before it on neighbouring lines, and counts claimed in comments."""
    rows = with_path(files).where((F.lower("suffix") == ".sql") & F.col("content").isNotNull())
    lines = rows.select("file_id", F.split(F.regexp_replace("content", "\r", ""), "\n").alias("ls"))
    each = lines.select("file_id", F.explode(F.transform("ls", lambda x, i: F.struct((i + 1).alias("line"), F.lower(F.trim(x)).alias("t"), F.lower(F.trim(F.coalesce(F.try_element_at("ls", i + 2), F.lit("")))).alias("u")))).alias("e"))
    t, u = F.col("e.t"), F.col("e.u")
    fault = F.when(t.rlike(r"\b(or|and)$") & u.rlike(r"^(or|and|\)|;|$)"), "empty operand").when(t.rlike(r"^--.*\b\d+ (rows|tables|columns)\b"), "count in a comment")
    return each.select("file_id", "e.line", fault.alias("fault")).where("fault is not null")
