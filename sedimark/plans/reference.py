"""Queries of the code-evidence operators over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import diff, documents, entities, evidence, gates, graph, inventory, ledger, routes
from sedimark.session import cut, table
from sedimark.streaming import twin

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, dir) under a name, with its SQL."""

    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _in(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


_P = r"trim(replace(rel_path, '\', '/'))"
_FILE = f"""f0 as (select *, {_P} as path from files), f1 as (select *, string_split(path, '/') as parts from f0),
 f as (select *, parts[-1] as base, list_slice(parts, 1, len(parts) - 1) as dirs, regexp_extract(parts[-1], '^.+(\\.[^.]*)$', 1) as suffix from f1)"""
_WALK = _FILE + f", w as (select * from f where not list_has_any(dirs, {_list(inventory.EXCLUDED_DIRS)}) and len(list_filter(dirs, lambda d: starts_with(d, '.'))) = 0)"
_GROUPABLE = _WALK + f", g as (select * from w where lower(suffix) not in {_in(inventory.EXCLUDED_EXTS)} and base not in {_in(inventory.EXCLUDED_FILES)})"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence")


# -- inventory -----------------------------------------------------------------------------------------------------------


@query("a1_walked", f"with {_WALK} select file_id, path from w")
def _(spark, d):
    return inventory.walked(_files(spark, d)).select("file_id", "path")


@query("a3_gitignored", f"with {_WALK} select file_id, path from w where (not regexp_matches(path, '(^|/)[^/]*\\.md(/.*)?$') and not regexp_matches(path, '(^|/)scripts/.*$') or regexp_matches(path, '(^|/)[^/]*_client[^/]*(/.*)?$'))")
def _(spark, d):
    return inventory.walked(_files(spark, d), ["# build results", "*.md", "scripts/", "!*_client*"]).select("file_id", "path")


@query(
    "a4_walk_order",
    f"with {_GROUPABLE}, k as (select distinct repo, path, list_transform(parts, lambda x, i: (case when i = len(parts) then '0' else '1' end) || x) as key from g) "
    "select repo, path, row_number() over (partition by repo order by key) - 1 as pos from k",
)
def _(spark, d):
    return inventory.walk_order(_files(spark, d))


@query("a5_groupable", f"with {_GROUPABLE} select repo, suffix, count(*) as n from g group by all")
def _(spark, d):
    return inventory.groupable(_files(spark, d)).groupBy("repo", "suffix").agg(F.count("*").alias("n"))


@query("a6_signatures", f"select file_id, repo, {_P} as path, sha256(content) as sha256 from files where content is not null")
def _(spark, d):
    return inventory.signatures(_files(spark, d))


@query("a7_scan_context", f"with {_WALK} select repo, count(*) filter (path like '%.java') as n_java, count(*) filter (path not like '%.java') as n_other, count(content) as n_signed from w group by repo")
def _(spark, d):
    return inventory.scan_context(_files(spark, d))


_CLASS = rf"""case when path like '%.java' then 'java||' when regexp_matches(base, '{inventory.CONFIG_NAME}') then 'config|configuration|config file'
 when base = 'libs.versions.toml' then 'deployment|deployment|version catalog'
 when base in ('pom.xml', 'build.xml') or suffix in ('.gradle', '.groovy') or base like '%.gradle.kts' then 'deployment|deployment|build script'
 when base in {_in(inventory.LOGGING_NAMES)} then 'other_relevant|observability|logging config file'
 when base like 'Dockerfile%' or regexp_matches(base, '^docker-compose.*\.ya?ml$') then 'deployment|deployment|container/compose file'
 when suffix in ('.yml', '.yaml') and list_has_any(parts, {_list(inventory.DEPLOY_DIRS)}) then 'deployment|deployment|deployment manifest'
 when contains(path, 'db/migration') or contains(path, 'db/changelog') or contains(path, 'migrations') then 'other_relevant|persistence|migration script' end"""


@query("b7_classified", f"with {_WALK}, c as (select file_id, repo, path, {_CLASS} as c from w) select file_id, repo, path, nullif(split_part(c, '|', 1), '') as category, nullif(split_part(c, '|', 2), '') as bucket, nullif(split_part(c, '|', 3), '') as found from c")
def _(spark, d):
    return inventory.classified(_files(spark, d))


@query("b7_category_counts", f"with {_WALK}, c as (select repo, split_part({_CLASS}, '|', 1) as c from w) select repo, k.category, count(*) filter (c = k.category) as n from c, (select unnest({_list(inventory.CATEGORIES)}) as category) k group by repo, k.category")
def _(spark, d):
    return inventory.category_counts(_files(spark, d))


_TOKENS = f"t as (select repo, path, arg_max(greatest(1, length(content) // (case when lower(suffix) in {_in(inventory.DENSE_EXTS)} then 3 else 4 end)), file_id) as tokens from g where content is not null group by repo, path)"


@query("g2_tokens", f"with {_GROUPABLE}, {_TOKENS} select repo, path, tokens from t")
def _(spark, d):
    return inventory.tokens_of(_files(spark, d))


@query("b21_source_sets", rf"with {_FILE} select nullif(regexp_extract(path, '(?:^|/)src/(main|test)/java/', 1), '') as source_set, count(*) as n from f where not regexp_matches(path, '(^|/)(build|target|generated|generated-sources)/') group by 1")
def _(spark, d):
    rows = inventory.with_path(_files(spark, d)).where(~F.col("path").rlike(r"(^|/)(build|target|generated|generated-sources)/"))
    return rows.groupBy(T.source_set(F.col("path")).alias("source_set")).agg(F.count("*").alias("n"))


# -- evidence ------------------------------------------------------------------------------------------------------------

_LINES = "l as (select {keep}, unnest(range(1, len(ls) + 1)) as line, unnest(ls) as text from (select *, string_split(replace(regexp_replace(content, '^﻿', ''), chr(13), ''), chr(10)) as ls from f where content is not null and {where}))"
_RULES = ", ".join("('" + r + "', '" + p.replace("'", "''") + "')" for r, p in evidence.RULES.items())


@query(
    "a9_rule_hits",
    f"with {_FILE}, {_LINES.format(keep='file_id, repo, path', where=chr(112) + 'ath like ' + repr('%.java'))}, r(rule_id, pattern) as (values {_RULES}) "
    "select file_id, repo, path as file, line, rule_id, substring(trim(text), 1, 200) as match from l join r on regexp_matches(text, pattern)",
)
def _(spark, d):
    return evidence.rule_hits(_files(spark, d))


@query(
    "a9_rule_coverage",
    f"with {_FILE}, {_LINES.format(keep='file_id, repo, path', where=chr(112) + 'ath like ' + repr('%.java'))}, r(rule_id, pattern) as (values {_RULES}) "
    "select rule_id, count(*) as n, count(distinct file_id) as n_files from l join r on regexp_matches(text, pattern) group by rule_id",
)
def _(spark, d):
    return evidence.rule_hits(_files(spark, d)).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))


_DEP = rf"\b({evidence.GRADLE_CONFIGURATIONS})\s*\(?\s*[''\"]([a-zA-Z0-9._\-]+):([a-zA-Z0-9._\-]*):?([a-zA-Z0-9._\-]*)[''\"]".replace('\\"', '"')


@query(
    "b8_gradle_dependencies",
    f"with {_FILE}, {_LINES.format(keep='file_id', where='suffix = ' + repr('.gradle'))}, b as (select file_id, line, regexp_replace(text, '(^|[^:])//.*$', '\\1') as text from l) "
    f"select file_id, line, regexp_extract(text, '{_DEP}', 1) as configuration, regexp_extract(text, '{_DEP}', 2) as \"group\", regexp_extract(text, '{_DEP}', 3) as name, nullif(regexp_extract(text, '{_DEP}', 4), '') as version from b where regexp_matches(text, '{_DEP}')",
)
def _(spark, d):
    return evidence.gradle_dependencies(_files(spark, d))


@query("b8_gradle_plugins", None)
def _(spark, d):
    return evidence.gradle_plugins(_files(spark, d))


@query(
    "b13_property_keys",
    rf"with {_FILE}, {_LINES.format(keep='file_id', where='suffix = ' + repr('.properties'))} select distinct file_id, regexp_extract(text, '^\s*([\w.\-]+)\s*[:=]', 1) as key from l where regexp_matches(text, '^\s*([\w.\-]+)\s*[:=]') and not regexp_matches(text, '^\s*[#!]')",
)
def _(spark, d):
    return evidence.property_keys(_files(spark, d))


@query("b14_yaml_keys")
def _(spark, d):
    return evidence.yaml_keys(_files(spark, d))


@query("b18_first_lines", r"select evidence_id, substring(regexp_replace(string_split(replace(match, chr(13) || chr(10), chr(10)), chr(10))[1], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 1, 200) as identity from evidence where match is not null")
def _(spark, d):
    return _evidence(spark, d).where("match is not null").select("evidence_id", T.first_line(F.col("match")).alias("identity"))


@query("b19_paths", r"select repo, trim(replace(file, '\', '/')) as path, count(*) as n, count(distinct file) as n_spellings from evidence where file is not null group by 1, 2")
def _(spark, d):
    rows = _evidence(spark, d).where("file is not null")
    return rows.groupBy("repo", T.posix(F.col("file")).alias("path")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_spellings"))


@query("b20_unknown_buckets", f"select rule_id, count(*) as n from evidence where rule_id is not null and split_part(rule_id, '__', 1) not in {_in(evidence.BUCKETS)} group by 1")
def _(spark, d):
    return evidence.unknown_buckets(_evidence(spark, d))


@query(
    "a11_located",
    rf"with {_FILE}, n as (select repo, path, arg_max(content, file_id) filter (content is not null) as content from f group by 1, 2), e as (select evidence_id, repo, trim(replace(file, '\', '/')) as path, line from evidence where file is not null) "
    "select evidence_id, case when line > 0 then string_split(replace(content, chr(13), ''), chr(10))[line] end as source_line from e join n using (repo, path)",
)
def _(spark, d):
    return evidence.located(_evidence(spark, d), _files(spark, d).where("content is not null"))


@query("d1_rule_counts", "select rule_id, count(*) as n from evidence group by 1")
def _(spark, d):
    return _evidence(spark, d).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("d2_bucket_rule_rollup", "select bucket, rule_id, cast(grouping(bucket) + grouping(rule_id) as int) as level, count(*) as n from evidence group by rollup (bucket, rule_id)")
def _(spark, d):
    return evidence.rollup_counts(_evidence(spark, d))


@query(
    "d3_emit_counts",
    "select repo, count(*) as n_rows, count(*) filter (rule_id is null) as n_unruled, count(*) filter (line is null) as n_unplaced, count(*) filter (scanner = 'codeql') as n_codeql, count(*) filter (scanner = 'astgrep') as n_astgrep, count(*) filter (bucket = 'references') as n_references, count(*) filter (match is null) as n_unmatched from evidence group by 1",
)
def _(spark, d):
    return evidence.emit_counts(_evidence(spark, d))


@query("d6_key_sets", r"select repo, trim(replace(file, '\', '/')) as file, array_to_string(list_sort(list(distinct key) filter (key is not null)), ',') as keys from (select repo, file, unnest(case when len(keys) > 0 then keys else [null] end) as key from config_key_sets) group by 1, 2")
def _(spark, d):
    rows = evidence.key_sets(table(spark, d, "config_key_sets"))
    return rows.withColumn("keys", F.when(F.size("keys") > 0, F.array_join("keys", ",")))


@query(
    "d7_zones",
    r"select repo, trim(replace(file, '\', '/')) as file, count(*) as n, count(distinct line) as n_lines, count(kind) as n_kinds from redaction_zones group by 1, 2",
)
def _(spark, d):
    return table(spark, d, "redaction_zones").groupBy("repo", T.posix(F.col("file")).alias("file")).agg(F.count("*").alias("n"), F.count_distinct("line").alias("n_lines"), F.count("kind").alias("n_kinds"))


@query("e1_first_seen", "select bucket, file, line, rule_id, evidence_id, match from (select *, row_number() over (partition by bucket, file, line, rule_id order by src_ord, row_ord, evidence_id) as rn from evidence) where rn = 1")
def _(spark, d):
    return evidence.first_seen(_evidence(spark, d), ["bucket", "file", "line", "rule_id"], ["src_ord", "row_ord", "evidence_id"], ["evidence_id", "match"])


@query(
    "e7_round_robin",
    "select evidence_id, bucket, turn from (select evidence_id, bucket, row_number() over (partition by bucket order by src_ord, row_ord, evidence_id) as turn from evidence) order by turn, bucket asc nulls last, evidence_id limit 60",
)
def _(spark, d):
    return evidence.round_robin(_evidence(spark, d), 60)


@query("b25_facts", r"""select coalesce(rule_id, 'EVIDENCE') as predicate, trim(replace(file, '\', '/')) as subject, match as object, '{"bucket":"' || coalesce(bucket, '') || '"}' as qualifiers, line, scanner, evidence_id from evidence where file is not null""")
def _(spark, d):
    return evidence.facts(_evidence(spark, d))


@query("b27_citations", "select coalesce('evidence.' || bucket, 'evidence') as source, count(*) as n, count(line) as n_placed from evidence group by 1 union all select 'cites.' || source as source, count(*) as n, count(line) as n_placed from cite_snapshots group by source")
def _(spark, d):
    a = _evidence(spark, d).select(F.coalesce(F.concat(F.lit("evidence."), "bucket"), F.lit("evidence")).alias("source"), "line")
    b = table(spark, d, "cite_snapshots").select(F.concat(F.lit("cites."), "source").alias("source"), "line")
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), F.count("line").alias("n_placed"))


_MODULE = "split_part(trim(replace(file, '\\', '/')), '/', 1)"


def _family(f: str) -> str:
    buckets, dep = evidence.FAMILIES[f]
    witness = f"min(e.path) filter (bucket = 'deployment' and regexp_matches(lower(coalesce(match, '')), '{dep}'))" if dep else "any_value(k.w)"
    return f"select e.repo, e.module, '{f}' as family, count(*) filter (bucket in {_in(buckets)}) as hits, {witness} as witness from ev e left join k on e.repo = k.repo and e.module = k.module group by e.repo, e.module"


@query(
    "d14_family_claims",
    f"with ev as (select *, {_MODULE} as module, trim(replace(file, '\\', '/')) as path from evidence where repo is not null and file is not null), k as (select repo, {_MODULE} as module, min(trim(replace(file, '\\', '/'))) as w from config_key_sets where len(keys) > 0 group by 1, 2), a as ("
    + " union all ".join(map(_family, evidence.FAMILIES))
    + ") select repo, module, family, case when witness is not null then 'ABSENCE' else 'UNPROVEN' end as predicate, witness from a where hits = 0",
)
def _(spark, d):
    module = F.split_part(T.posix(F.col("file")), F.lit("/"), F.lit(1)).alias("module")
    rows = _evidence(spark, d).where("file is not null").select("*", module)
    return evidence.family_claims(rows, table(spark, d, "config_key_sets").select("*", module), ["repo", "module"])


@query(
    "f_contract_violations",
    "select evidence_id, v.violation from evidence, (select unnest(['file missing', 'line below one', 'rule missing', 'bucket missing', 'rule outside its bucket', 'scanner missing']) as violation) v where case v.violation when 'file missing' then file is null or trim(file) = '' when 'line below one' then line < 1 when 'rule missing' then rule_id is null when 'bucket missing' then bucket is null when 'rule outside its bucket' then rule_id is not null and bucket is not null and split_part(rule_id, '__', 1) <> bucket else scanner is null end",
)
def _(spark, d):
    return gates.evidence_violations(_evidence(spark, d))


@query(
    "j15_ratchet",
    "with a as (select rule_id, count(*) as n from evidence where scanner = 'astgrep' group by 1), b as (select rule_id, count(*) as n from evidence where scanner = 'codeql' group by 1) "
    "select coalesce(a.rule_id, b.rule_id) as rule_id, coalesce(a.n, 0) as was, coalesce(b.n, 0) as now, case when coalesce(a.n, 0) > 0 and coalesce(b.n, 0) = 0 then 'lost' when coalesce(a.n, 0) = 0 and coalesce(b.n, 0) > 0 then 'new' when coalesce(b.n, 0) > coalesce(a.n, 0) then 'grew' when coalesce(b.n, 0) < coalesce(a.n, 0) then 'shrank' else 'same' end as verdict from a full outer join b on a.rule_id = b.rule_id",
)
def _(spark, d):
    n = lambda s: _evidence(spark, d).where(F.col("scanner") == s).groupBy("rule_id").agg(F.count("*").alias("n"))
    return diff.ratchet(n("astgrep"), n("codeql"))


@query(
    "e6_failure_budget",
    "with o as (select bucket, row_number() over (order by file, coalesce(line, 0), evidence_id) as rn from evidence where file is not null and scanner is null) select count(*) as n, count(*) filter (rn <= 200) as kept, case when count(*) filter (bucket = 'security') > 0 then 1 - (count(*) filter (bucket = 'security' and rn <= 200)) / (count(*) filter (bucket = 'security')) end as loss from o",
)
def _(spark, d):
    rows = _evidence(spark, d).where("file is not null and scanner is null").withColumn("at", F.coalesce("line", F.lit(0)))
    return diff.failure_budget(rows, F.col("bucket") == "security", ["file", "at", "evidence_id"], 200)


@query(
    "h12_token_keys",
    "select file, rule_id, count(*) as n, count(distinct match) as n_texts, count(distinct array_to_string(regexp_extract_all(regexp_replace(match, '//[^\\n]*|/\\*[^*]*\\*+([^/*][^*]*\\*+)*/', ' ', 'g'), '(\"[^\"]*\"|[A-Za-z0-9_$]+|[^\\sA-Za-z0-9_$])', 1), chr(31))) as n_keys from evidence where match is not null group by all",
)
def _(spark, d):
    rows = _evidence(spark, d).where("match is not null")
    return rows.groupBy("file", "rule_id").agg(F.count("*").alias("n"), F.count_distinct("match").alias("n_texts"), F.count_distinct(T.token_key(F.col("match"))).alias("n_keys"))


@query("k_rule_counts_by_day", "select date_trunc('day', scanned_at) as start, rule_id as key, count(*) as n from evidence where scanned_at is not null group by 1, 2")
def _(spark, d):
    return twin.rule_counts(_evidence(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


# -- entities, queries, imports --------------------------------------------------------------------------------------------

_ENT = r"""e0 as (select file_id, repo, path as file, content, regexp_extract(content, '\bclass\s+(\w+)', 1) as class_name, regexp_extract(regexp_extract(content, '@Table\s*\(([^)]*)\)', 1), 'name\s*=\s*"([^"]+)"', 1) as explicit, nullif(regexp_extract(content, '(?m)^\s*package\s+([\w.]+)\s*;', 1), '') as package from f where path like '%.java' and regexp_matches(content, '(?m)^\s*@(Entity|Table)\b')),
 e as (select *, case when explicit <> '' then explicit else lower(regexp_replace(regexp_replace(replace(class_name, '.', '_'), '([a-z])([A-Z][a-z])', '\1_\2', 'g'), '([a-z])([A-Z][a-z])', '\1_\2', 'g')) end as "table" from e0 where class_name <> '')"""


@query(
    "b15_entities",
    f"with {_FILE}, {_ENT} select file_id, repo, file, class_name, \"table\", case when explicit <> '' then 'explicit' else 'inferred-default-naming' end as table_name_source, package, case when package is null then class_name else package || '.' || class_name end as fqcn, 'code spring . ' || coalesce(replace(package, '.', '/') || '/', '') || class_name || '#' as symbol from e",
)
def _(spark, d):
    return entities.entities(_files(spark, d))


@query(
    "d4_entity_map",
    f"with {_FILE}, {_ENT} select repo, class_name, min((file, \"table\"))[1] as file, min((file, \"table\"))[2] as \"table\", case when count(distinct (file, \"table\")) > 1 then 'contested' else 'single' end as status, count(distinct (file, \"table\")) as n_candidates from e group by 1, 2".replace("min((file, \"table\"))[1]", "min({'f': file, 't': \"table\"}).f").replace("min((file, \"table\"))[2]", "min({'f': file, 't': \"table\"}).t"),
)
def _(spark, d):
    return entities.entity_map(entities.entities(_files(spark, d)))


@query("h4_symbols", f"with {_FILE}, {_ENT} select coalesce(len(string_split(package, '.')), 0) as n_namespaces, count(*) as n, count(distinct class_name) as n_types from e group by 1")
def _(spark, d):
    rows = entities.entities(_files(spark, d)).withColumn("p", T.parse_symbol(F.col("symbol")))
    return rows.groupBy(F.size("p.namespaces").alias("n_namespaces")).agg(F.count("*").alias("n"), F.count_distinct(F.element_at("p.type_names", -1)).alias("n_types"))


_QUERY = r"""q as (select evidence_id, repo, case when regexp_matches(match, '(?i)nativeQuery\s*[=:]\s*true') then 'native' else 'jpql' end as query_kind, nullif(regexp_extract(match, '"([^"]*)"', 1), '') as query from evidence where regexp_matches(match, '(?i)^\s*@?Query\s*\('))"""


@query("b17_queries", f"with {_QUERY} select * from q")
def _(spark, d):
    return entities.evidence_queries(_evidence(spark, d))


@query("h7_jpql_lineage", None)
def _(spark, d):
    found = entities.entity_map(entities.entities(_files(spark, d)))
    both = entities.evidence_queries(_evidence(spark, d)).unionByName(entities.annotated_queries(_files(spark, d)).select((-F.col("file_id") * 1000 - F.col("nth")).alias("evidence_id"), "repo", "query_kind", "query"))
    return entities.jpql_lineage(both.where("query_kind = 'jpql'"), found)


@query("h6_native_tables", rf"with {_QUERY} select evidence_id, array_to_string(list_sort(list_distinct(regexp_extract_all(query, '(?i)\b(?:from|join)\s+([A-Za-z_][\w.]*)', 1))), ',') as tables from q where query_kind = 'native' and query is not null")
def _(spark, d):
    return entities.read_tables(entities.evidence_queries(_evidence(spark, d))).select("evidence_id", F.array_join("tables", ",").alias("tables"))


@query(
    "h25_schema_refs",
    rf"with {_QUERY} select query_kind, count(*) as n, count(*) filter (regexp_matches(query, '(?i)\bjson')) as n_json, count(distinct lower(regexp_extract(query, '(?i)\bfrom\s+(\w+)', 1))) as n_sources from q where query is not null group by 1",
)
def _(spark, d):
    rows = entities.evidence_queries(_evidence(spark, d)).where("query is not null")
    return rows.groupBy("query_kind").agg(F.count("*").alias("n"), F.count_if(F.col("query").rlike(r"(?i)\bjson")).alias("n_json"), F.count_distinct(F.lower(F.regexp_extract("query", r"(?i)\bfrom\s+(\w+)", 1))).alias("n_sources"))


_IMPORTS = r"""j as (select repo, path as file, content, regexp_extract(content, '(?m)^\s*package\s+([\w.]+)\s*;', 1) as package, regexp_extract(path, '([^/]+)\.java$', 1) as stem from f where path like '%.java' and content is not null),
 decl as (select repo, package, stem, max(file) as file from j where package <> '' group by 1, 2, 3), memb as (select distinct repo, package, file from j where package <> ''),
 imp as (select distinct repo, file, regexp_replace(x, '^static\s+', '') as qualified, starts_with(x, 'static ') as static from (select repo, file, unnest(regexp_extract_all(content, '(?m)^\s*import\s+((?:static\s+)?[\w.]+(?:\.\*)?)\s*;', 1)) as x from j)),
 probe as (select *, unnest(case when qualified like '%.*' then [len(string_split(qualified, '.')) - 1] else range(1, greatest(len(string_split(qualified, '.')), 2)) end) as depth from imp where contains(qualified, '.')),
 p2 as (select *, array_to_string(list_slice(string_split(qualified, '.'), 1, depth), '.') as package, case when qualified not like '%.*' then string_split(qualified, '.')[depth + 1] end as stem from probe),
 hit as (select p2.repo, p2.file, qualified, static, depth, d.file as target, 'exact' as confidence from p2 join decl d on p2.repo = d.repo and p2.package = d.package and p2.stem = d.stem
  union all select p2.repo, p2.file, qualified, static, depth, m.file as target, 'package-fanout' as confidence from p2 join memb m on p2.repo = m.repo and p2.package = m.package),
 best as (select * from (select *, rank() over (partition by repo, file, qualified, static order by depth desc, confidence) as rk from hit) where rk = 1),
 res as (select repo, file, qualified, static, target, confidence from best union all select i.repo, i.file, i.qualified, i.static, null, 'unresolved' from imp i where not exists (select 1 from best b where b.repo = i.repo and b.file = i.file and b.qualified = i.qualified and b.static = i.static))"""


def _java(spark, d) -> DataFrame:
    return graph.parsed(_files(spark, d).where("repo is not null"))


def _resolved(java: DataFrame) -> DataFrame:
    return graph.resolve(graph.imports(java), graph.declarations(java), graph.members(java))


@query("c1_resolved_imports", f"with {_FILE}, {_IMPORTS} select * from res")
def _(spark, d):
    return _resolved(_java(spark, d))


_COVER = "cover as (select repo, path as file, cast(row_number() over (partition by repo order by path) // 12 as int) as g from (select distinct repo, path from f where path like '%.java' and content is not null))"


def _cover(java: DataFrame) -> DataFrame:
    """A cover by path order, twelve files a group; a file at a seam belongs to both groups."""
    from sedimark.functions.ordered import range_index

    return range_index(java.select("repo", "file").distinct(), ["repo"], ["file"], "n").select("repo", "file", F.floor((F.col("n") + 1) / 12).cast("int").alias("group_id"))


@query(
    "c4_cut_edges",
    f"with {_FILE}, {_IMPORTS}, {_COVER} select distinct r.repo, r.file, r.target, r.qualified, r.confidence from res r left join cover a on r.repo = a.repo and r.file = a.file left join cover b on r.repo = b.repo and r.target = b.file where r.target is not null and r.target <> r.file and (a.g is null or b.g is null or a.g <> b.g)",
)
def _(spark, d):
    java = _java(spark, d)
    return graph.cut_edges(_resolved(java), graph.membership(_cover(java).withColumnRenamed("file", "path")))


@query(
    "c6_adjacency",
    f"with {_FILE}, {_IMPORTS}, {_COVER}, s as (select repo, package, count(*) as n from memb group by 1, 2 having count(*) > 1), i as (select m.repo, m.package, c.g as group_id, count(*) as n_inside from memb m join cover c on m.repo = c.repo and m.file = c.file group by 1, 2, 3) "
    "select i.repo, i.package, i.group_id, n_inside, n - n_inside as n_outside from i join s on i.repo = s.repo and i.package = s.package where n_inside < n",
)
def _(spark, d):
    java = _java(spark, d)
    return graph.adjacency(graph.members(java), _cover(java))


@query("g1_groups", None)
def _(spark, d):
    files = _files(spark, d)
    return graph.group_files(inventory.walk_order(files).join(inventory.tokens_of(files), ["repo", "path"]))


@query("g3_membership", None)
def _(spark, d):
    return graph.membership(QUERIES["g1_groups"](spark, d))


_PKG = f"with {_FILE}, {_IMPORTS}, e as (select distinct m.repo || ':' || m.package as src, m.repo || ':' || t.package as dst from res r join memb m on r.repo = m.repo and r.file = m.file join memb t on r.repo = t.repo and r.target = t.file where m.package <> t.package)"


def _package_edges(spark, d):
    java = _java(spark, d)
    m = graph.members(java)
    rows = _resolved(java).where("target is not null").join(m, ["repo", "file"]).join(m.select("repo", F.col("file").alias("target"), F.col("package").alias("to")), ["repo", "target"])
    return rows.where("package <> to").select(F.concat_ws(":", "repo", "package").alias("src"), F.concat_ws(":", "repo", "to").alias("dst")).distinct()


@query("g4_package_closure", _PKG.replace("with ", "with recursive ", 1) + ", c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src) select src, dst from c")
def _(spark, d):
    return graph.closure(_package_edges(spark, d)).select("src", "dst")


@query("c17_most_specific", None)
def _(spark, d):
    edges = _package_edges(spark, d)
    return graph.most_specific(edges.select(F.col("src").alias("id"), F.col("dst").alias("type")), graph.closure(edges))


@query(
    "c13_routes",
    r"""select distinct repo, v as verb, case when p = '/' then p else regexp_replace(p, '/$', '') end as path from (select repo, unnest(case when upper(w) = 'REQUEST' then ['GET','PUT','POST','DELETE','OPTIONS','HEAD','PATCH','TRACE'] else [upper(w)] end) as v, regexp_replace('/' || regexp_replace(raw, '\{([^}:]+):[^}]*\}', '{\1}', 'g'), '/+', '/', 'g') as p from (select repo, regexp_extract(match, '^\s*@?(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(', 1) as w, regexp_extract(match, '(?:path|value)?\s*[=:]?\s*"([^"]*)"', 1) as raw from evidence where regexp_matches(match, '^\s*@?(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(')) where raw <> '')""",
)
def _(spark, d):
    return routes.code_routes(_evidence(spark, d))


@query("c14_route_join", None)
def _(spark, d):
    spec = table(spark, d, "cite_snapshots").where("rule_id like 'api_surface%'")
    return routes.join_routes(routes.code_routes(_evidence(spark, d)), routes.code_routes(spec))


# -- differences, rates ------------------------------------------------------------------------------------------------------

_SIG = "s as (select * from file_signatures where snapshot_no is not null qualify row_number() over (partition by snapshot_no, repo, path order by loaded_at desc, sha256 desc nulls last) = 1)"


def _pairs(rows: str, cols: str) -> str:
    """old and new: the rows of a relation's neighbouring snapshots of a repo, by the later one."""
    return (
        f"steps as (select repo as r, snapshot_no as n, lag(snapshot_no) over (partition by repo order by snapshot_no) as p from (select distinct repo, snapshot_no from {rows} where snapshot_no is not null)), "
        f"new as (select x.snapshot_no, {cols} from {rows} x join steps t on x.repo is not distinct from t.r and x.snapshot_no = t.n where t.p is not null), "
        f"old as (select t.n as snapshot_no, {cols} from {rows} x join steps t on x.repo is not distinct from t.r and x.snapshot_no = t.p)"
    )


@query(
    "c9_file_status",
    f"with {_SIG}, {_pairs('s', 'x.repo, x.path, x.sha256')} select coalesce(a.snapshot_no, b.snapshot_no) as snapshot_no, coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path, case when a.snapshot_no is null then 'added' when b.snapshot_no is null then 'deleted' when a.sha256 is not distinct from b.sha256 then 'unchanged' else 'changed' end as status from old a full outer join new b on a.snapshot_no = b.snapshot_no and a.repo is not distinct from b.repo and a.path is not distinct from b.path",
)
def _(spark, d):
    return diff.file_status(table(spark, d, "file_signatures"))


@query(
    "c11_bag_match",
    f"with {_pairs('cite_snapshots', 'x.repo, x.rule_id, x.match')}, b as (select snapshot_no, repo, rule_id, match, count(*) filter (o = 1) as n_old, count(*) filter (o = 0) as n_new from (select *, 1 as o from old union all select *, 0 as o from new) group by 1, 2, 3, 4) select *, least(n_old, n_new) as confirmed, n_old - least(n_old, n_new) as drifted from b where n_old > 0",
)
def _(spark, d):
    return diff.bag_match(*diff.neighbours(table(spark, d, "cite_snapshots")), ["snapshot_no", "repo", "rule_id", "match"])


_DELTA = f"with {_pairs('cite_snapshots', 'x.repo, x.file, x.rule_id, x.match')}, a as (select distinct * from old), b as (select distinct * from new), f as (select 'added' as side, * from (select * from b except select * from a) union all select 'removed' as side, * from (select * from a except select * from b))"


@query("f3_set_delta", f"{_DELTA} select * from f")
def _(spark, d):
    return diff.set_delta(*diff.neighbours(table(spark, d, "cite_snapshots")), ["snapshot_no", "repo", "file", "rule_id", "match"])


@query(
    "f4_residue",
    f"{_DELTA} select r.relation, snapshot_no, repo, count(*) as n from f, (select unnest(['unchanged', 'grows_only', 'confined_to_rules', 'confined_to']) as relation) r where case r.relation when 'unchanged' then true when 'grows_only' then side = 'removed' when 'confined_to_rules' then not coalesce(rule_id in ('persistence__entity', 'raw_queries__query'), false) else not coalesce(file like '%.java', false) end group by 1, 2, 3",
)
def _(spark, d):
    delta = cut(QUERIES["f3_set_delta"](spark, d))
    found = [diff.residue(delta, r, c).withColumn("relation", F.lit(r)) for r, c in (("unchanged", None), ("grows_only", None), ("confined_to_rules", ["persistence__entity", "raw_queries__query"]))]
    found.append(delta.where(~F.coalesce(F.col("file").like("%.java"), F.lit(False))).withColumn("relation", F.lit("confined_to")))
    return ledger.union_tagged({str(i): x for i, x in enumerate(found)}).groupBy("relation", "snapshot_no", "repo").agg(F.count("*").alias("n"))


@query("f7_key_delta", None)
def _(spark, d):
    fresh = evidence.property_keys(_files(spark, d)).join(inventory.with_path(_files(spark, d)).select("file_id", "repo", F.col("path").alias("file")), "file_id").groupBy("repo", "file").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return diff.key_delta(evidence.key_sets(table(spark, d, "config_key_sets")).where("file like '%.properties'"), fresh)


def _signed(spark, d) -> DataFrame:
    """The signatures of every snapshot, with repo and snapshot as one scope."""
    rows = diff.latest(table(spark, d, "file_signatures").where("snapshot_no is not null"), ["snapshot_no", "repo", "path"], ["sha256"])
    return rows.withColumn("scope", F.concat_ws("#", F.coalesce("repo", F.lit("")), "snapshot_no"))


@query(
    "d10_inventory_root",
    f"with {_SIG}, o as (select distinct coalesce(repo, '') || '#' || snapshot_no as scope, path, coalesce(sha256, '') as sha256 from s where path is not null) select scope, sha256(string_agg(path || chr(0) || sha256 || chr(10), '' order by path, sha256)) as root from o group by 1",
)
def _(spark, d):
    return diff.inventory_root(_signed(spark, d), "scope")


@query("d10_merkle_root", None)
def _(spark, d):
    return diff.merkle_root(_signed(spark, d), ("snapshot_no", "repo"))


@query("j6_covering", None)
def _(spark, d):
    signed = _signed(spark, d).withColumnRenamed("repo", "r").withColumnRenamed("scope", "repo")
    parts = {"all_signatures": F.lit(True), "java_only": F.col("path").endswith(".java"), "non_java": ~F.col("path").endswith(".java")}
    roots = cut(ledger.union_tagged({k: diff.merkle_root(signed.where(c)) for k, c in parts.items()}, "scope"))
    whole = roots.where("scope = 'all_signatures'")
    proofs = whole.select("repo", F.lit(1).alias("schema_version"), F.col("root").alias("inventory_root"), F.lit("v1").alias("scanner_version"), F.col("root").alias("barrier_root"), F.lit("v1").alias("known_version"))
    acked = diff.merkle_root(signed.where("sha256 is not null")).select("repo", F.col("root").alias("acked"))  # files without a signature were never acknowledged
    both = roots.join(acked, "repo", "left").select("repo", F.hash("scope").alias("nth"), F.concat(F.lit("arm of "), "scope").alias("scanner"), F.lit("complete").alias("status"), "scope", F.col("root").alias("expected_root"), F.when(F.col("scope") == "all_signatures", F.col("acked")).otherwise(F.col("root")).alias("acked_root"))
    return gates.covering_verdict(proofs, both, roots)


@query("d22_certification", None)
def _(spark, d):
    return gates.certification_fold(table(spark, d, "artifacts"))


@query("h20_pseudonyms", "select distinct 'repo_' || left(sha256('salt' || repo), 12) as name from files where repo is not null")
def _(spark, d):
    return _files(spark, d).where("repo is not null").select(T.pseudonym("repo", F.col("repo"), "salt").alias("name")).distinct()


# -- documents ---------------------------------------------------------------------------------------------------------------


@query(
    "d19_tag_counts",
    r"""with t as (select doc_id, coalesce(text, '') as text from documents) select doc_id, len(regexp_extract_all(text, '\[Evidenced — [^\];]+(?:; inference avoided beyond this)?\]')) as evidenced, len(regexp_extract_all(text, '\[Confirmed — interview, [^\]]+\]')) as confirmed,
 len(regexp_extract_all(text, '\[Unknown — not evidenced in code, not covered in interview\]')) as unknown, len(regexp_extract_all(text, '\[Per existing docs — [^,]+, unverified against code\]')) as per_existing_docs,
 len(regexp_extract_all(text, '\[(?:Evidenced|Confirmed|Unknown|Per existing docs)\b[^\]]*\]')) - len(list_filter(regexp_extract_all(text, '\[(?:Evidenced|Confirmed|Unknown|Per existing docs)\b[^\]]*\]'), lambda s: regexp_matches(s, '^(?:\[Evidenced — [^\];]+(?:; inference avoided beyond this)?\]|\[Confirmed — interview, [^\]]+\]|\[Unknown — not evidenced in code, not covered in interview\]|\[Per existing docs — [^,]+, unverified against code\])$'))) as malformed,
 len(regexp_extract_all(text, '(?i)\[(?:evidenced|confirmed|unknown|per existing docs)\b[^\]]*\]')) - len(regexp_extract_all(text, '\[(?:Evidenced|Confirmed|Unknown|Per existing docs)\b[^\]]*\]')) as miscased from t""",
)
def _(spark, d):
    return documents.tag_counts(table(spark, d, "documents"))


@query("c18_citations", None)
def _(spark, d):
    return documents.resolve_citations(table(spark, d, "documents"), _files(spark, d))


@query("h16_claim_units", None)
def _(spark, d):
    return documents.claim_units(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


@query("h17_untagged_claims", None)
def _(spark, d):
    return documents.untagged_claims(table(spark, d, "documents"))


_STOP = "[" + ", ".join(f"'{w}'" for w in documents.STOPWORDS) + "]"
_CLAIMS = r"""p as (select doc_id, doc_type, unnest(regexp_extract_all(text, '([^\n\]]*)\[Confirmed — interview, [^\]]+\]', 1)) as prefix, unnest(range(len(regexp_extract_all(text, '([^\n\]]*)\[Confirmed — interview, [^\]]+\]', 1)))) as nth from documents where text is not null),
 c as (select doc_id, doc_type, nth, trim(string_split(regexp_replace(rtrim(prefix), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[-1]) as claim from p), """


@query(
    "c22_closest",
    "with " + _CLAIMS + f"""w as (select doc_id * 100000 + nth as id, doc_id, doc_type, list_sort(list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z0-9]+'), lambda x: length(x) > 1 and not list_contains({_STOP}, x)))) as ws from c where claim <> ''),
 a as (select * from w where len(ws) > 0 and doc_id % 100 = 0), b as (select ws, min(id) as id from w where len(ws) > 0 and doc_type = 'interview' group by 1),
 j as (select a.id as left_id, b.id as right_id, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) as overlap from a, b)
 select left_id, arg_max(right_id, (overlap, -right_id)) as right_id, max(overlap) as overlap from j where overlap >= 0.15 group by 1""",
)
def _(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null")
    claims = documents.tagged_claims(docs).join(docs.select("doc_id", "doc_type").distinct(), "doc_id").select((F.col("doc_id") * 100_000 + F.col("nth")).alias("id"), "doc_id", "doc_type", F.col("claim").alias("text"))
    asked = claims.where("doc_id % 100 = 0").select("id", "text")  # the stated set of queries
    return documents.closest(asked, claims.where("doc_type = 'interview'").select("id", "text"))


@query("g12_diagrams", None)
def _(spark, d):
    return documents.diagrams(table(spark, d, "documents"))
