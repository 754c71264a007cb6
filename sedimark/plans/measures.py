"""Queries of facts and measures (`operators/ledger.py`), each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import diff, documents, entities, evidence, gates, graph, inventory, ledger, nested, verify
from sedimark.plans import reference
from sedimark.plans.reference import _ENT, _FILE, _GROUPABLE, _IMPORTS, _QUERY, _TOKENS, _WALK, _cover, _evidence, _files, _in, _java, _list, _resolved, _SIG
from sedimark.session import cut, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


# -- readers and keys --------------------------------------------------------------------------------------------------------


@query("a13_decoded", "select evidence_id, rule_id, cast(line as varchar) as line from evidence")
def _(spark, d):
    """Columnar results written as JSON and decoded again."""
    rows = _evidence(spark, d).select("evidence_id", F.lit('["rule","line"]').alias("columns"), F.to_json(F.array(F.array("rule_id", F.col("line").cast("string")))).alias("tuples"))
    return ledger.decoded(rows, "columns", "tuples").select("evidence_id", F.col("row")["rule"].alias("rule_id"), F.col("row")["line"].alias("line"))


@query("a14_union", "select 'evidence' as query_file, count(*) as n, count(line) as n_placed from evidence union all select 'cite_snapshots' as query_file, count(*) as n, count(line) as n_placed from cite_snapshots union all select 'skipped_files' as query_file, count(*) as n, 0 as n_placed from skipped_files having count(*) > 0")
def _(spark, d):
    every = ledger.union_tagged({n: table(spark, d, n).drop("snapshot_no") for n in ("evidence", "cite_snapshots", "skipped_files")})
    return every.groupBy("query_file").agg(F.count("*").alias("n"), F.count("line").alias("n_placed"))


_COMMANDS = f"b as (select repo, path, base, list_position({_list(ledger.BUILD_FILES)}, base) as o, len(parts) as dep from f), k as (select repo, arg_min((path, base), (dep, o, path)) as m from b where o > 0 group by 1), cmd as (select repo, m[2] as build_file, '\"' || case when m[2] like 'gradlew%' or m[2] like 'mvnw%' then m[1] when m[2] like 'build.gradle%' then 'gradle' else 'mvn' end || '\" ' || case when contains(m[2], 'gradle') then '--no-daemon clean compileJava compileTestJava' else '--no-daemon clean compile test-compile' end as command from k)".replace("(path, base)", "{'p': path, 'b': base}").replace("m[2]", "m.b").replace("m[1]", "m.p")


@query("a16_build_commands", f"with {_FILE}, {_COMMANDS} select *, cast(null as varchar) as fault from cmd")
def _(spark, d):
    return ledger.build_command(_files(spark, d)).withColumn("fault", ledger.command_fault(F.col("command")))


@query(
    "a15_cache_keys",
    f"with {_FILE}, {_COMMANDS}, {_SIG}, o as (select distinct coalesce(repo, '') || '#' || snapshot_no as scope, repo, path, coalesce(sha256, '') as sha256 from s where path is not null), r as (select scope, any_value(repo) as repo, sha256(string_agg(path || chr(0) || sha256 || chr(10), '' order by path, sha256)) as root from o group by 1) "
    "select scope as repo, sha256(root || chr(0) || coalesce(command, '') || chr(0) || 'rules-1') as key from r left join cmd on r.repo = cmd.repo",
)
def _(spark, d):
    roots = diff.inventory_root(reference._signed(spark, d), "scope")
    commands = ledger.build_command(_files(spark, d)).join(reference._signed(spark, d).select("repo", "scope").distinct(), "repo").select(F.col("scope").alias("repo"), "command")
    return ledger.cache_keys(roots.withColumnRenamed("scope", "repo"), commands, "rules-1")


@query("a18_line_ranges", "select file_id, array_to_string(list_slice(string_split(replace(content, chr(13), ''), chr(10)), 3, 7), chr(10)) as lines from files where content is not null")
def _(spark, d):
    return _files(spark, d).where("content is not null").select("file_id", ledger.line_range(F.col("content"), 3, 5).alias("lines"))


# -- extraction --------------------------------------------------------------------------------------------------------------


@query("b9_maven")
def _(spark, d):
    return verify.maven(_files(spark, d))


_TOML = r"l0 as (select file_id, unnest(string_split(replace(content, chr(13), ''), chr(10))) as l from f where base = 'libs.versions.toml' and content is not null), t as (select file_id, regexp_extract(l, '^\s*([\w.-]+)\s*=', 1) as key, nullif(regexp_extract(l, '\bmodule\s*=\s*\"([^\"]+)\"', 1), '') as m, case when regexp_matches(l, '\bgroup\s*=\s*\"[^\"]+\"') and regexp_matches(l, '\bname\s*=\s*\"[^\"]+\"') then regexp_extract(l, '\bgroup\s*=\s*\"([^\"]+)\"', 1) || ':' || regexp_extract(l, '\bname\s*=\s*\"([^\"]+)\"', 1) end as p, nullif(regexp_extract(l, '^\s*[\w.-]+\s*=\s*\"([^\"]+)\"\s*(?:#.*)?$', 1), '') as v from l0)".replace('\\"', '"')


@query("b10_catalogues", f"with {_FILE}, {_TOML} select file_id, case when coalesce(m, p) is not null then 'library' else 'version' end as kind, key, coalesce(m, p, v) as value from t where coalesce(m, p, v) is not null and key <> ''")
def _(spark, d):
    return verify.version_catalog(_files(spark, d))


@query("b11_build_signals")
def _(spark, d):
    return ledger.build_signals(_files(spark, d))


@query("b12_blanked")
def _(spark, d):
    rows = inventory.with_path(_files(spark, d)).where(F.col("suffix").isin(".gradle", ".java") & F.col("content").isNotNull())
    both = rows.select("file_id", "content", verify.blank_comments(F.col("content")).alias("b"))
    return both.select("file_id", F.sha2("b", 256).alias("blanked"), (F.length("b") == F.length("content")).alias("same_length"))


_ROOTS = rf"(?:{ledger.REPOSITORY_ROOTS})\s*<\s*([^,>]+?)\s*,\s*([^>]+?)\s*>"


@query("b16_repositories", rf"with {_FILE} select file_id, repo, path as file, nullif(regexp_extract(content, '\binterface\s+(\w+)', 1), '') as repository, regexp_extract(content, '{_ROOTS}', 1) as entity, regexp_extract(content, '{_ROOTS}', 2) as id_type from f where path like '%.java' and regexp_matches(content, '{_ROOTS}')")
def _(spark, d):
    return ledger.repositories(_files(spark, d))


@query("b22_java_sources", f"with {_FILE} select repo, count(*) filter (path like '%.java') as n_java, count(*) as n from f group by 1")
def _(spark, d):
    return inventory.with_path(_files(spark, d)).groupBy("repo").agg(F.count_if(ledger.is_java_source(F.col("path"))).alias("n_java"), F.count("*").alias("n"))


@query(
    "b23_todo_sweep",
    rf"with {_WALK}, l0 as (select repo, path, unnest(string_split(replace(content, chr(13), ''), chr(10))) as l, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from w where content is not null and (lower(suffix) in {_in(ledger.SWEPT)} or lower(base) = 'dockerfile')), m as (select distinct repo, path, cast(line as int) as line, regexp_extract(l, '\b({ledger.MARKERS})\b', 1) as marker, substring(trim(l), 1, 200) as text from l0) select * from m where marker <> '' order by repo nulls first, path, line limit 200",
)
def _(spark, d):
    return ledger.todo_sweep(_files(spark, d))


@query(
    "b26_maps_to",
    f"with {_FILE}, {_ENT}, u as (select repo, class_name, file, \"table\", min(case when explicit <> '' then 'explicit' else 'inferred-default-naming' end) as src, min(coalesce(package, '')) as package from e group by 1, 2, 3, 4), n as (select repo, class_name, count(*) as n from u group by 1, 2) "
    "select u.repo, 'code spring . ' || case when package <> '' then replace(package, '.', '/') || '/' else '' end || u.class_name || '#' as subject, \"table\" as object, file, case when n > 1 then 'contested' else 'single' end as status, src as table_name_source from u join n on u.repo is not distinct from n.repo and u.class_name = n.class_name",
)
def _(spark, d):
    return ledger.maps_to(entities.entities(_files(spark, d)))


@query("b30_python_checks")
def _(spark, d):
    return ledger.python_checks(_files(spark, d))


# -- lineage and rates -------------------------------------------------------------------------------------------------------


def _lineage(spark, d) -> DataFrame:
    """(repo, evidence_id, file, line, query_kind, query, available, reason, entity): the query rows of evidence with their lineage."""
    found = entities.entity_map(entities.entities(_files(spark, d)))
    rows = entities.evidence_queries(_evidence(spark, d))
    jpql = entities.jpql_lineage(rows.where("query_kind = 'jpql'"), found)
    jpql = jpql.select("repo", "evidence_id", "query_kind", "query", F.col("source_table").isNotNull().alias("available"), "reason", F.when(F.col("reason").isNull(), F.col("entity")).alias("entity"))
    native = entities.read_tables(rows).select("repo", "evidence_id", "query_kind", "query", (F.size("tables") > 0).alias("available"), F.when(F.size("tables") == 0, "unparsable statement").alias("reason"), F.lit(None).cast("string").alias("entity"))
    null = rows.where("query is null").select("repo", "evidence_id", "query_kind", "query", F.lit(False).alias("available"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("entity"))
    places = _evidence(spark, d).select("evidence_id", T.posix(F.col("file")).alias("file"), "line").where("evidence_id is not null")
    return jpql.unionByName(native).unionByName(null).join(places, "evidence_id")


@query("b28_resolved_queries")
def _(spark, d):
    return _lineage(spark, d).where("entity is not null").select("repo", "evidence_id", "entity", "query")


@query("c12_provenance_recheck")
def _(spark, d):
    rows = _lineage(spark, d).select("repo", "evidence_id", "entity")
    results = rows.select("repo", "evidence_id", F.when(F.col("evidence_id") % 3 == 0, "drifted").otherwise("confirmed").alias("status"))
    old = entities.entity_map(entities.entities(_files(spark, d).where("committed_at is not null"))).withColumnRenamed("class_name", "entity")
    new = entities.entity_map(entities.entities(_files(spark, d))).withColumnRenamed("class_name", "entity")
    return ledger.provenance_recheck(results, rows, old, new)


@query("d12_lineage_strata")
def _(spark, d):
    return ledger.lineage_strata(_lineage(spark, d))


@query("e5_failures")
def _(spark, d):
    return ledger.failures(_lineage(spark, d))


@query("d32_dominant")
def _(spark, d):
    return ledger.dominant(ledger.failures(_lineage(spark, d)))


@query(
    "h9_reason_classes",
    "select r as reason, c as class from (values ('', 'unavailable_unknown'), ('InvalidSyntaxException: x', 'dialect_or_syntax'), ('statement is Unparsable', 'dialect_or_syntax'), ('contested entity', 'contested_refuse'), ('entity not found', 'entity_lookup'), ('No entity', 'entity_lookup'), ('unknown entity', 'entity_lookup'), ('other', 'unavailable_other')) v(r, c) where exists (select 1 from evidence)",
)
def _(spark, d):
    reasons = ("", "InvalidSyntaxException: x", "statement is Unparsable", "contested entity", "entity not found", "No entity", "unknown entity", "other")
    rows = _evidence(spark, d).limit(1).select(F.explode(F.array(*map(F.lit, reasons))).alias("reason"))
    return rows.select("reason", ledger.reason_class(F.col("reason")).alias("class"))


_NATIVE = r"names as (select evidence_id, unnest(list_distinct(regexp_extract_all(query, '(?i)\b(?:from|join|into|update)\s+((?:<default>\.)?[A-Za-z_][\w.]*)', 1))) as name from q where query_kind = 'native' and query is not null)"


@query("h8_table_names", rf"with {_QUERY}, {_NATIVE} select regexp_replace(name, '^<default>\.', '') as name, count(*) as n from names group by 1")
def _(spark, d):
    rows = entities.evidence_queries(_evidence(spark, d)).where("query_kind = 'native' and query is not null")
    names = F.explode(F.array_distinct(F.regexp_extract_all("query", F.lit(r"(?i)\b(?:from|join|into|update)\s+((?:<default>\.)?[A-Za-z_][\w.]*)"), 1)))
    return rows.select(names.alias("name")).groupBy(ledger.clean_table(F.col("name")).alias("name")).agg(F.count("*").alias("n"))


def _claims(spark, d) -> DataFrame:
    return reference.QUERIES["d14_family_claims"](spark, d)


@query("d15_callable_trials", f"with c as ({reference.SQL['d14_family_claims']}) select repo, count(witness) as n_callable, count(*) filter (predicate = 'ABSENCE') as n_absent, count(*) filter (predicate = 'UNPROVEN') as n_unproven from c group by 1")
def _(spark, d):
    return ledger.callable_trials(_claims(spark, d), ["repo"])


@query("d11_rates")
def _(spark, d):
    """The seven rates of each repo."""
    found = entities.entities(_files(spark, d))
    facts = ledger.maps_to(found)
    sym = facts.groupBy("repo").agg(T.rate(F.count_if(F.col("subject").isNotNull() & (T.parse_symbol(F.col("subject"))["kind"] == "type")), F.count("*")).alias("r_sym"))
    coll = entities.entity_map(found).groupBy("repo").agg(T.rate(F.count_if(F.col("status") == "contested"), F.count("*")).alias("r_coll"))
    from sedimark.plans.checks import QUERIES as CHECKS

    join = CHECKS["c7_or_join"](spark, d).select("repo", T.rate(F.col("hit"), F.col("n")).alias("r_join"))
    lin = ledger.lineage_strata(_lineage(spark, d)).where("scoring = 'callable' and stratum = 'all'").select("repo", F.col("rate").alias("r_lin"))
    dep = evidence.family_support(_evidence(spark, d)).groupBy("repo").agg(T.rate(F.sum("supported"), F.count("*")).alias("r_code_dep"))
    absent = ledger.callable_trials(_claims(spark, d), ["repo"]).select("repo", T.rate(F.col("n_absent"), F.col("n_callable")).alias("r_absence"), "n_absent", "n_unproven")
    recall = QUERIES["d24_recall"](spark, d).select("repo", F.col("recall").alias("r_recall"))
    out = sym
    for part in (coll, join, lin, dep, absent, recall):
        out = out.join(part, "repo", "full_outer")
    return out


@query("d13_uncertainty")
def _(spark, d):
    u = diff.uncertainty(F.col("r_coll"), F.col("r_join"), F.col("r_lin"), F.col("r_code_dep"), F.coalesce("n_absent", F.lit(0)), F.coalesce("n_unproven", F.lit(0)))
    return QUERIES["d11_rates"](spark, d).select("repo", u.alias("u")).select("repo", "u.u", "u.claim")


_ARMS = "a as (select distinct repo, file, rule_id, bucket from evidence where scanner = 'codeql'), a1 as (select repo, file, rule_id, min(bucket) as cause from a group by 1, 2, 3), b as (select distinct repo, file, rule_id, 1 as hit from evidence where scanner = 'astgrep'), m as (select case when a1.k then a1.repo else b.repo end as repo, case when a1.k then a1.file else b.file end as file, case when a1.k then a1.rule_id else b.rule_id end as rule_id, cause, coalesce(a1.k, false) as ina, hit is not null as inb from (select *, true as k from a1) a1 full outer join b on a1.repo is not distinct from b.repo and a1.file is not distinct from b.file and a1.rule_id is not distinct from b.rule_id)"


def _compared(spark, d) -> DataFrame:
    side = lambda s: _evidence(spark, d).where(F.col("scanner") == s)
    return ledger.arm_comparison(side("codeql").withColumnRenamed("bucket", "cause"), side("astgrep"), ["repo", "file", "rule_id"])


@query("c24_compared", f"with {_ARMS} select repo, file, rule_id, case when not inb then 'missed' when not ina then 'false positive' else 'matched' end as verdict, case when not inb then cause end as cause from m")
def _(spark, d):
    return _compared(spark, d)


@query(
    "d24_recall",
    f"with {_ARMS}, n as (select repo, count(*) filter (ina and inb) as matched, count(*) filter (ina and not inb) as missed, count(*) filter (inb and not ina) as false_positives from m group by 1) select repo, matched + missed as oracle_total, matched, missed, false_positives, case when matched + missed > 0 then matched / (matched + missed) end as recall, case when matched + false_positives > 0 then matched / (matched + false_positives) end as precision from n",
)
def _(spark, d):
    return ledger.arm_summary(_compared(spark, d), "repo")


@query("d24_by_cause", f"with {_ARMS} select repo, cause, count(*) as n from m where not inb group by 1, 2")
def _(spark, d):
    return _compared(spark, d).where("verdict = 'missed'").groupBy("repo", "cause").agg(F.count("*").alias("n"))


def _names(spark, d, scanner: str) -> DataFrame:
    return _evidence(spark, d).where((F.col("scanner") == scanner) & (F.col("rule_id") == "persistence__entity") & F.col("file").isNotNull()).select("repo", entities.class_of(F.col("file")).alias("name")).where("name <> ''")


@query("c23_miss_facts")
def _(spark, d):
    known = entities.entities(_files(spark, d)).select("repo", F.col("class_name").alias("name"), "file")
    return ledger.recall_misses(_names(spark, d, "codeql"), _names(spark, d, "astgrep"), known)


@query("d34_writer_facts")
def _(spark, d):
    roots = diff.merkle_root(diff.latest(table(spark, d, "file_signatures").where("snapshot_no is not null"), ["repo", "path"], ["sha256"])).withColumn("scope", F.lit("all_signatures"))
    proofs = roots.select("repo", F.lit(1).alias("schema_version"), F.col("root").alias("inventory_root"), F.lit("v1").alias("scanner_version"), F.col("root").alias("barrier_root"), F.lit("v1").alias("known_version"))
    arms = _evidence(spark, d).where("scanner is not null").select("repo", "scanner").distinct()
    receipts = arms.join(roots, "repo").select("repo", F.hash("scanner").alias("nth"), "scanner", F.lit("complete").alias("status"), "scope", F.col("root").alias("expected_root"), F.col("root").alias("acked_root"))
    return ledger.writer_facts(gates.covering_verdict(proofs, receipts, roots), receipts, _claims(spark, d), QUERIES["c23_miss_facts"](spark, d))


# -- maps, edges -------------------------------------------------------------------------------------------------------------

_BY_PATH = "case when file like '%/test/%' then 2 when file like '%/main/%' then 0 else 1 end"


@query(
    "d5_merged_maps",
    f"with {_FILE}, {_ENT}, x as (select repo, class_name, {_BY_PATH} as src, file, \"table\" from e) select repo, class_name, min({{'s': src, 'f': file, 't': \"table\"}}).s as src, min({{'s': src, 'f': file, 't': \"table\"}}).f as file, min({{'s': src, 'f': file, 't': \"table\"}}).t as \"table\", case when count(distinct (file, \"table\")) > 1 then 'contested' else 'single' end as status, count(distinct (file, \"table\")) as n_candidates from x group by 1, 2",
)
def _(spark, d):
    src = F.when(F.col("file").contains("/test/"), 2).when(F.col("file").contains("/main/"), 0).otherwise(1)
    return ledger.merged_maps(entities.entities(_files(spark, d)).select("repo", "class_name", src.alias("src"), "file", "table"))


@query("d8_first_signatures", "select repo, path, arg_min(sha256, (snapshot_no, coalesce(loaded_at, timestamp '0001-01-01'), sha256)) filter (sha256 is not null) as sha256 from file_signatures group by 1, 2")
def _(spark, d):
    return ledger.first_signatures(table(spark, d, "file_signatures"))


@query("d9_files_scanned", f"with c as ({reference.SQL['b7_category_counts']}) select category, cast(sum(n) as bigint) as n from c group by 1")
def _(spark, d):
    return ledger.summed(inventory.category_counts(_files(spark, d)), ["category"])


_CUT = f"{_FILE}, {_IMPORTS}, {reference._COVER}, ce as (select distinct r.repo, r.file, r.target, r.qualified, r.confidence from res r left join cover a on r.repo = a.repo and r.file = a.file left join cover b on r.repo = b.repo and r.target = b.file where r.target is not null and r.target <> r.file and (a.g is null or b.g is null or a.g <> b.g))"


def _edges(spark, d):
    java = _java(spark, d)
    cover, resolved = cut(_cover(java)), cut(_resolved(java))
    return java, cover, resolved, graph.cut_edges(resolved, graph.membership(cover.withColumnRenamed("file", "path")))


@query("c5_sides", f"with {_CUT} select ce.repo, g as group_id, 'outbound' as side, ce.file, target, qualified, confidence from ce join cover c on ce.repo = c.repo and ce.file = c.file union all select ce.repo, g as group_id, 'inbound' as side, ce.file, target, qualified, confidence from ce join cover c on ce.repo = c.repo and ce.target = c.file")
def _(spark, d):
    _, cover, _, arcs = _edges(spark, d)
    return ledger.edge_sides(arcs, cover)


@query(
    "d35_edge_stats",
    f"with {_CUT}, sides as (select ce.repo from ce join cover c on ce.repo = c.repo and ce.file = c.file union all select ce.repo from ce join cover c on ce.repo = c.repo and ce.target = c.file), ps as (select repo, package, count(*) as n from memb group by 1, 2 having count(*) > 1), ad as (select m.repo, m.package, c.g, any_value(ps.n) - count(*) as n_outside from memb m join cover c on m.repo = c.repo and m.file = c.file join ps on ps.repo = m.repo and ps.package = m.package group by 1, 2, 3 having any_value(ps.n) > count(*)), "
    "fl as (select repo, count(distinct file) as nf from j where repo is not null group by 1), gr as (select repo, count(distinct g) as ng from cover where repo is not null group by 1), ct as (select repo, count(*) as cut_arcs, count(*) filter (confidence = 'exact') as exact, count(*) filter (confidence = 'package-fanout') as fanout from ce group by 1), un as (select repo, count(*) filter (confidence = 'unresolved') as unresolved from res group by 1), sd as (select repo, count(*) as ns from sides group by 1), aj as (select repo, cast(sum(n_outside) as bigint) as na from ad group by 1), "
    "z as (select fl.repo, coalesce(cut_arcs, 0) as cut_arcs, coalesce(exact, 0) as exact, coalesce(fanout, 0) as fanout, coalesce(unresolved, 0) as unresolved, coalesce(ns, 0) + coalesce(na, 0) as rows_shipped, nf * coalesce(ng, 0) as broadcast_rows from fl left join gr using (repo) left join ct using (repo) left join un using (repo) left join sd using (repo) left join aj using (repo)) select *, case when rows_shipped > 0 then broadcast_rows / rows_shipped end as reduction from z",
)
def _(spark, d):
    java, cover, resolved, arcs = _edges(spark, d)
    arcs = cut(arcs)
    return ledger.edge_totals(resolved, arcs, ledger.edge_sides(arcs, cover), graph.adjacency(graph.members(java), cover), cover, java.groupBy("repo").agg(F.count_distinct("file").alias("n_files")))


# -- orders and sets ---------------------------------------------------------------------------------------------------------


@query("e3_sorted_evidence", "select evidence_id, bucket, row_number() over (partition by bucket order by file nulls first, coalesce(line, 0), evidence_id) - 1 as pos from evidence where evidence_id is not null")
def _(spark, d):
    from sedimark.functions.ordered import range_index

    rows = _evidence(spark, d).where("evidence_id is not null").select("evidence_id", "bucket", "file", F.coalesce("line", F.lit(0)).alias("at"))
    return range_index(rows, ["bucket"], ["file", "at", "evidence_id"], "pos").select("evidence_id", "bucket", "pos")


@query(
    "e4_sorted_facts",
    r"select evidence_id, row_number() over (partition by coalesce(rule_id, 'EVIDENCE') order by trim(replace(file, '\', '/')), coalesce(match, ''), coalesce(line, -1), evidence_id) - 1 as pos from evidence where file is not null and evidence_id is not null",
)
def _(spark, d):
    from sedimark.functions.ordered import range_index

    rows = evidence.facts(_evidence(spark, d)).where("evidence_id is not null").select("evidence_id", "predicate", "subject", F.coalesce("object", F.lit("")).alias("object"), F.coalesce("line", F.lit(-1)).alias("at"))
    return range_index(rows, ["predicate"], ["subject", "object", "at", "evidence_id"], "pos").select("evidence_id", "pos")


@query("e9_adjacent", "select * from (select repo, cite_id, lead(cite_id) over (partition by repo order by cite_id) as next from (select distinct repo, cite_id from cite_snapshots)) where next is not null")
def _(spark, d):
    return ledger.adjacent(table(spark, d, "cite_snapshots").select("repo", "cite_id").distinct(), ["repo"], ["cite_id"], "cite_id")


@query("e10_node_ids", f"with {_FILE}, {_ENT}, u as (select class_name, file, repo, row_number() over (partition by class_name order by repo, file) as n from (select distinct class_name, file, repo from e)) select repo, file, class_name, case when n > 1 then class_name || '_' || n else class_name end as node from u")
def _(spark, d):
    rows = entities.entities(_files(spark, d)).select("repo", "file", "class_name").distinct()
    return graph.unique_ids(rows, "class_name", ["repo", "file"])


_EXPECTED = ("application.yml", "build.gradle", "Dockerfile", "pom.xml", "README.md", "settings.gradle")


@query("f6_expected", f"with {_FILE}, h as (select distinct base as name from f where len(parts) <= 2) select name, 'missing' as verdict from (select unnest({_list(_EXPECTED)}) as name) where name not in (select name from h) and exists (select 1 from files) union all select name, 'extra' as verdict from h where name not in {_in(_EXPECTED)}")
def _(spark, d):
    names = inventory.with_path(_files(spark, d)).where(F.size(F.split("path", "/")) <= 2).select(F.col("base").alias("name"))
    return gates.expected_set(names, list(_EXPECTED)).join(_files(spark, d).limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_semi")


@query(
    "f9_write_scope",
    r"with f0 as (select repo, trim(replace(file, '\', '/')) as path from skipped_files where file is not null) select repo, path from f0 where not regexp_matches(path, '^(docs(/|$)|.*/docs(/|$))')",
)
def _(spark, d):
    text = table(spark, d, "skipped_files").where("file is not null").select(F.col("repo").alias("doc_id"), F.concat(F.lit(" M "), T.posix(F.col("file"))).alias("text"))
    return ledger.out_of_scope(ledger.changed_paths(text), ["docs", ".*/docs"]).select(F.col("doc_id").alias("repo"), "path")


# -- closures ----------------------------------------------------------------------------------------------------------------

#: Which annotations of the framework are annotated with which others.
META = {
    "RestController": ["Controller", "ResponseBody"], "Controller": ["Component"], "Service": ["Component"], "Repository": ["Component"], "Configuration": ["Component"],
    "SpringBootApplication": ["SpringBootConfiguration", "EnableAutoConfiguration", "ComponentScan"], "SpringBootConfiguration": ["Configuration"], "RestControllerAdvice": ["ControllerAdvice", "ResponseBody"],
    "ControllerAdvice": ["Component"], "GetMapping": ["RequestMapping"], "PostMapping": ["RequestMapping"], "PutMapping": ["RequestMapping"], "PatchMapping": ["RequestMapping"], "DeleteMapping": ["RequestMapping"],
}
_META = "m(src, dst) as (values " + ", ".join(f"('{a}', '{b}')" for a, bs in META.items() for b in bs) + "), mc as (select src, dst from m union select mc.src, m.dst from mc join m on mc.dst = m.src)"


@query("g5_meta_annotations", f"with recursive {_META}, used as (select distinct file_id, regexp_extract(x, '@(\\w+)', 1) as name from (select evidence_id as file_id, unnest(regexp_extract_all(match, '@\\w+')) as x from evidence where match is not null)) select dst as annotation, count(distinct file_id) as n from (select file_id, name as dst from used union all select file_id, dst from used join mc on used.name = mc.src) where dst in (select dst from m) group by 1")
def _(spark, d):
    """Rows of evidence that are annotated with each meta-annotation, directly or by another annotation."""
    edges = spark.createDataFrame([(a, b) for a, bs in META.items() for b in bs], "src string, dst string")
    used = _evidence(spark, d).where("match is not null").select("evidence_id", F.explode(F.array_distinct(F.regexp_extract_all("match", F.lit(r"@(\w+)"), 1))).alias("name"))
    closed = graph.closure(edges).select(F.col("src").alias("name"), "dst").unionByName(edges.select(F.col("dst").alias("name"), "dst")).distinct()
    return used.join(F.broadcast(closed), "name").groupBy(F.col("dst").alias("annotation")).agg(F.count_distinct("evidence_id").alias("n"))


@query("g6_discovered_annotations")
def _(spark, d):
    """Annotations declared in source, with all that they are annotated with, directly or not; cycles are fine."""
    java = inventory.with_path(_files(spark, d)).where(F.col("path").endswith(".java") & F.col("content").contains("@interface"))
    head = F.regexp_extract("content", r"((?:@\w+(?:\([^)]*\))?\s*)*)(?:public\s+)?@interface\s+(\w+)", 1)
    name = F.regexp_extract("content", r"@interface\s+(\w+)", 1)
    rows = java.select(name.alias("src"), F.explode(F.regexp_extract_all(head, F.lit(r"@(\w+)"), 1)).alias("dst")).where("src <> ''")
    return graph.closure(rows).select("src", "dst")


@query("g7_reaches_roots")
def _(spark, d):
    """Types that extend one of the repository roots, over any number of types of the same repo."""
    edges = verify.supertypes(_files(spark, d)).where("repo is not null").select("repo", F.col("sub").alias("src"), F.element_at(F.split("super", r"\."), -1).alias("dst"))
    roots = spark.createDataFrame([(r,) for r in ledger.REPOSITORY_ROOTS.split("|")], "name string")
    return graph.reaching(edges, roots)


@query("g4_type_closure")
def _(spark, d):
    edges = verify.supertypes(_files(spark, d)).where("repo is not null").select(F.concat_ws(":", "repo", "sub").alias("src"), F.concat_ws(":", "repo", F.element_at(F.split("super", r"\."), -1)).alias("dst")).distinct()
    return graph.closure(edges).select("src", "dst", "depth")


# -- documents and claims ------------------------------------------------------------------------------------------------------


@query("c21_undefined_nodes")
def _(spark, d):
    return documents.diagrams(table(spark, d, "documents")).select("doc_id", "nth", F.explode("undefined").alias("node"))


@query("c25_declared_names", f"with {_FILE}, {_ENT}, p as (select distinct unnest(regexp_extract_all(text, '`([A-Za-z_]\\w*)`', 1)) as name from documents where text is not null), k as (select distinct class_name as name from e) select coalesce(p.name, k.name) as name, case when k.name is null then 'prose only' when p.name is null then 'code only' else 'both' end as verdict from p full outer join k on p.name = k.name")
def _(spark, d):
    return ledger.declared_names(table(spark, d, "documents"), entities.entities(_files(spark, d)).select(F.col("class_name").alias("name")))


@query("d20_interview_counts", rf"with t as (select doc_type, len(regexp_extract_all(coalesce(text, ''), '{documents.TAGS['confirmed']}')) as a, len(regexp_extract_all(coalesce(text, ''), '{documents.TAGS['unknown']}')) as s from documents) select doc_type, cast(sum(a + s) as bigint) as asked, cast(sum(a) as bigint) as answered, cast(sum(s) as bigint) as skipped from t group by 1 having sum(a + s) > 0")
def _(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    each = lambda k, s: docs.select("doc_type", F.explode(documents.all_of(F.col("text"), documents.TAGS[k])).alias("t")).select("doc_type", F.lit(s).alias("status"))
    return ledger.interview_counts(each("confirmed", "answered").unionByName(each("unknown", "skipped")), ["doc_type"])


@query("d26_claim_metrics", rf"with c as (select coalesce(doc_type, 'none') as status, len(regexp_extract_all(coalesce(text, ''), '{documents.TAGS['evidenced']}')) as n_predicates, strftime(written_at, '%Y-%m-%d') as dated from documents) select status, count(*) as n, count(*) filter (n_predicates > 0) as n_falsifiable, cast(sum(n_predicates) as bigint) as n_predicates, min(dated) as oldest from c group by 1")
def _(spark, d):
    n = F.coalesce(F.size(documents.all_of(F.coalesce("text", F.lit("")), documents.TAGS["evidenced"])), F.lit(0))
    return ledger.claim_metrics(table(spark, d, "documents").select(F.coalesce("doc_type", F.lit("none")).alias("status"), n.alias("n_predicates"), F.date_format("written_at", "yyyy-MM-dd").alias("dated")))


_COUNTED = ("files", "evidence", "documents", "cite_snapshots", "artifacts")


@query("d27_derived_counts", " union all ".join(f"select '{n}' as name, count(*) as n from {n} having count(*) > 0" for n in _COUNTED))
def _(spark, d):
    return ledger.derived_counts({n: table(spark, d, n) for n in _COUNTED}).where("n > 0")


@query("h18_claim_symbols")
def _(spark, d):
    rows = documents.tagged_claims(table(spark, d, "documents"), "evidenced").withColumn("symbols", documents.claim_symbols(F.col("claim")))
    return rows.where("size(symbols) > 0").select("doc_id", "nth", F.array_join("symbols", ",").alias("symbols"))


@query(
    "h26_mappings",
    r"""with m as (select evidence_id, match, upper(regexp_extract(match, '(?i)@?(Get|Post|Put|Patch|Delete|Request)Mapping\b', 1)) as w, regexp_extract(match, '(?i)method\s*[=:]\s*\{?\s*(?:RequestMethod\.)?(\w+)', 1) as named, regexp_extract(match, '(?i)\b(?:path|value)\s*[=:]\s*\{?\s*["''`“”]([^"''`“”]*)', 1) as p, regexp_extract(match, '\(\s*["''`“”]([^"''`“”]*)', 1) as q, nullif(regexp_extract(match, '\$\{([^:}]+)', 1), '') as key from evidence where match is not null)
 select evidence_id, case when w = '' then null when w <> 'REQUEST' then w when named <> '' then upper(named) else 'ANY' end as verb, nullif(case when p <> '' then p else q end, '') as path, key from m where w <> '' or key is not null""",
)
def _(spark, d):
    rows = _evidence(spark, d).where("match is not null").select("evidence_id", ledger.http_method(F.col("match")).alias("verb"), ledger.mapping_path(F.col("match")).alias("path"), ledger.value_key(F.col("match")).alias("key"))
    return rows.where("verb is not null or key is not null")


@query("h13_perturbed")
def _(spark, d):
    """How many Java files keep their tokens under each layout."""
    java = inventory.with_path(_files(spark, d)).where(F.col("path").endswith(".java") & F.col("content").isNotNull())
    own = T.token_key(F.col("content"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("layout"), (T.token_key(c) == own).alias("same"), (c != F.col("content")).alias("moved")) for k, c in ledger.perturbed(F.col("content")).items()]))
    return java.select(each.alias("e")).groupBy("e.layout").agg(F.count("*").alias("n"), F.count_if(F.col("e.moved")).alias("n_moved"), F.count_if(F.col("e.same")).alias("n_same"))


# -- runs and gates ------------------------------------------------------------------------------------------------------------


@query("d17_pool_tokens", f"with {_GROUPABLE}, {_TOKENS}, a as (select repo, cast(sum(tokens) as bigint) as proxy from t group by 1), b as (select repo, cast(sum(greatest(1, length(match) // 4)) as bigint) as measured from evidence where match is not null group by 1) select a.repo, proxy, measured, proxy * {ledger.LAST_FANOUT} as proxy_all, case when proxy > 0 then measured / proxy end as ratio from a left join b on a.repo = b.repo")
def _(spark, d):
    signals = _evidence(spark, d).where("match is not null").select("repo", F.greatest(F.lit(1), F.floor(F.length("match") / 4)).alias("tokens"))
    return ledger.pool_tokens(inventory.tokens_of(_files(spark, d)), signals)


@query("d21_fanout")
def _(spark, d):
    stages = gates.records(table(spark, d, "artifacts"), "stages")
    keys = F.element_at(F.array(*map(F.lit, ledger.STAGE_OF)), (F.pmod(F.hash("name"), F.lit(len(ledger.STAGE_OF))) + 1).cast("int"))
    predicted = stages.groupBy(keys.alias("key")).agg(F.count("*").alias("n"))
    return ledger.fanout(predicted, stages.groupBy(F.col("name").alias("stage")).agg(F.count("*").alias("n")))


@query("d23_run_status")
def _(spark, d):
    return ledger.run_status(gates.records(table(spark, d, "artifacts"), "stages"), "artifact_id")


@query("j2_groups_complete")
def _(spark, d):
    groups = cut(reference.QUERIES["g1_groups"](spark, d))
    declared = groups.groupBy("repo").agg(F.max("group_id").alias("num_groups"))  # ids count from 0, so every repo is one short
    return gates.groups_complete(groups, declared)


@query("j4_question_faults")
def _(spark, d):
    """Confirmed claims read as questions that block the document's kind."""
    docs = table(spark, d, "documents")
    claims = documents.tagged_claims(docs).join(docs.groupBy("doc_id").agg(F.max("doc_type").alias("doc_type"), F.max("source").alias("source")), "doc_id")
    return gates.question_faults(claims.select("doc_id", F.col("nth").alias("place"), F.col("doc_type").alias("blocks_file"), F.lit("claim").alias("topic"), F.col("claim").alias("question"), F.col("claim").alias("evidence")), ["architecture", "runbook"], 5)


@query("j5_finding_faults")
def _(spark, d):
    gates_ = nested.nodes(table(spark, d, "artifacts")).where("schema_path = 'gates[]'")
    f = F.col("fields")
    anchors = F.from_json(F.regexp_replace(F.coalesce(f["checks"], F.lit("[]")), '"hits":', '"line":'), "array<struct<line:string,what:string>>")
    rows = gates_.select(F.col("artifact_id").alias("doc_id"), F.col("node_path").alias("place"), f["id"].alias("lens"), f["status"].alias("severity"), anchors.alias("anchors"), f["detail"].alias("verdict"), F.expr("array('A', 'C')").alias("tiers"))
    return gates.finding_faults(rows.withColumn("verdict", F.nullif("verdict", F.lit(""))), ["G1", "G2", "G3"], ["ok", "fail"], ["supported"])


@query("j7_barrier", "with x as (select r.repo, s.scanner from (select distinct repo from evidence where repo is not null) r, (select unnest(['astgrep', 'codeql', 'filesystem']) as scanner) s), h as (select repo, scanner, max(case when bucket = 'security' then 1 else 0 end) as ok from evidence group by 1, 2) select x.repo, x.scanner, case when h.repo is null then 'missing' else 'incomplete' end as fault from x left join h on x.repo = h.repo and x.scanner = h.scanner where coalesce(ok, 0) = 0")
def _(spark, d):
    """Scanners of each repo without a row of the security bucket, which stands for their receipt here."""
    repos = _evidence(spark, d).where("repo is not null").select("repo").distinct()
    expected = repos.select("repo", F.explode(F.array(*map(F.lit, ("astgrep", "codeql", "filesystem")))).alias("scanner"))
    receipts = _evidence(spark, d).select("repo", "scanner", F.when(F.col("bucket") == "security", "complete").otherwise("running").alias("status"))
    return gates.barrier(expected, receipts)


@query("j8_accepted")
def _(spark, d):
    rows = table(spark, d, "artifacts").where("artifact_id is not null")
    status, n = F.get_json_object("payload", "$.status"), F.size(F.from_json(F.get_json_object("payload", "$.files_scanned"), "map<string,string>"))
    return gates.accepted(rows.select("artifact_id", F.coalesce(status, F.when(F.col("payload").isNotNull(), "complete")).alias("status"), n.alias("n_signatures")))


@query("j10_profile_stages")
def _(spark, d):
    stages = gates.records(table(spark, d, "artifacts"), "stages").withColumn("name", F.regexp_replace("name", r"_\d+$", ""))
    return gates.staged_rows(stages, ["rank_meter", "settle_quarry", "trim_ledger", "dispatch_voucher"], "trim_ledger").groupBy("name").agg(F.count("*").alias("n"))


@query("j11_rewritten")
def _(spark, d):
    rows = nested.nodes(table(spark, d, "artifacts")).where("schema_path = 'stages[]'").select("artifact_id", F.col("fields")["name"].alias("name"), F.col("fields")["executor"].alias("executor"))
    return gates.rewritten(rows, rows.where("executor = 'mock'").withColumn("executor", F.lit("external"))).groupBy("executor").agg(F.count("*").alias("n"))


@query("j12_gates")
def _(spark, d):
    return gates.gate_results({"contract": gates.evidence_violations(_evidence(spark, d)), "barrier": QUERIES["j7_barrier"](spark, d), "statics": ledger.static_faults(_files(spark, d))}).where("n_violations > 0")


@query("j13_expectations", "with c as (select rule_id, count(*) as n from evidence group by 1), x(rule_id, block, want) as (values ('persistence__entity', 'minimums', 1), ('references__import', 'asserted', 0), ('never__seen', 'minimums', 2), ('never__seen', 'asserted', 0)) select x.rule_id, block, want, coalesce(n, 0) as n from x left join c on x.rule_id = c.rule_id where case when block = 'minimums' then coalesce(n, 0) < want else coalesce(n, 0) <> want end and exists (select 1 from evidence)")
def _(spark, d):
    expected = spark.createDataFrame([("persistence__entity", "minimums", 1), ("references__import", "asserted", 0), ("never__seen", "minimums", 2), ("never__seen", "asserted", 0)], "rule_id string, block string, want int")
    counts = _evidence(spark, d).groupBy("rule_id").agg(F.count("*").alias("n"))
    return gates.expectations(counts, expected).join(_evidence(spark, d).limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_semi")


@query("j14_static_faults")
def _(spark, d):
    return ledger.static_faults(_files(spark, d))


@query("j18_mutants", "with r as (select rule_id || ':' || coalesce(cast(line as varchar), '') as mutant, max(case when match is not null then 1 else 0 end) as k from evidence where rule_id is not null group by 1), a as (select distinct rule_id || ':' || coalesce(cast(line as varchar), '') as mutant from cite_snapshots where rule_id is not null and match is null) select coalesce(r.mutant, a.mutant) as mutant, case when a.mutant is not null and coalesce(k = 1, true) then 'stale' when k = 1 then 'killed' when a.mutant is not null then 'accepted' else 'new survivor' end as verdict from r full outer join a on r.mutant = a.mutant")
def _(spark, d):
    name = F.concat_ws(":", "rule_id", F.coalesce(F.col("line").cast("string"), F.lit("")))
    runs = _evidence(spark, d).where("rule_id is not null").select(name.alias("mutant"), F.col("match").isNotNull().alias("killed"))
    return gates.mutants(runs, table(spark, d, "cite_snapshots").where("rule_id is not null and match is null").select(name.alias("mutant")))
