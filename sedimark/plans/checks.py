"""Queries of the verification operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import diff, documents, entities, gates, graph, inventory, typed, verify
from sedimark.operators.evidence import BUCKETS
from sedimark.plans.reference import _ENT, _FILE, _GROUPABLE, _IMPORTS, _TOKENS, _evidence, _files, _in, _list, _pairs
from sedimark.session import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


_CITED = "z as (select snapshot_no, repo, cite_id, rule_id, match from (select *, row_number() over (partition by snapshot_no, repo, cite_id order by loaded_at desc, rule_id desc, match desc) as rn from cite_snapshots where snapshot_no is not null) where rn = 1)"


@query(
    "c10_recheck",
    f"with {_CITED}, {_pairs('z', 'x.repo, x.cite_id, x.rule_id, x.match')}, j as (select a.snapshot_no, a.repo, a.cite_id, b.snapshot_no is not null as t, a.rule_id is distinct from b.rule_id as r, a.match is distinct from b.match as m from old a left join new b on a.snapshot_no = b.snapshot_no and a.repo is not distinct from b.repo and a.cite_id is not distinct from b.cite_id) "
    "select snapshot_no, repo, cite_id, case when not t then 'missing' when r or m then 'drifted' else 'confirmed' end as status, case when t then concat_ws(',', case when r then 'rule_id' end, case when m then 'match' end) end as moved from j",
)
def _(spark, d):
    keys = ["snapshot_no", "repo", "cite_id"]
    return verify.recheck(*diff.neighbours(diff.latest(table(spark, d, "cite_snapshots").where("snapshot_no is not null"), keys, ["rule_id", "match"])), keys, ["rule_id", "match"])


@query(
    "c7_or_join",
    f"with {_FILE}, {_ENT}, {_IMPORTS}, n as (select distinct repo, case when package is null then class_name else package || '.' || class_name end as fqcn, class_name from e), k as (select distinct repo, qualified from imp where qualified not like '%.*'), s as (select distinct repo, split_part(qualified, '.', -1) as simple from k) "
    "select n.repo, count(*) as n, count(*) filter (exists (select 1 from k where k.repo = n.repo and k.qualified = n.fqcn) or exists (select 1 from s where s.repo = n.repo and s.simple = n.class_name)) as hit from n group by 1",
)
def _(spark, d):
    names = entities.entities(_files(spark, d)).where("repo is not null").select("repo", "fqcn", "class_name").distinct()
    seen = graph.imports(graph.parsed(_files(spark, d))).where("not endswith(qualified, '.*')").select("repo", F.explode(F.array(F.col("qualified"), F.element_at(F.split("qualified", r"\."), -1))).alias("key")).distinct()
    keyed = names.select("*", F.explode(F.array_distinct(F.array("fqcn", "class_name"))).alias("key"))
    hit = keyed.join(seen, ["repo", "key"], "left_semi").select("repo", "fqcn", "class_name").distinct().withColumn("hit", F.lit(1))
    return names.join(hit, ["repo", "fqcn", "class_name"], "left").groupBy("repo").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))


@query("c19_anchors", None)
def _(spark, d):
    return verify.anchors(_evidence(spark, d), _files(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("c20_contained", None)
def _(spark, d):
    nodes = documents.diagrams(table(spark, d, "documents")).select(F.explode("undefined").alias("name"))
    names = entities.entities(_files(spark, d)).select(F.col("class_name").alias("name"))
    return verify.contained(nodes, names)


@query("c23_recall_misses", "select distinct repo, file, rule_id from evidence a where scanner = 'codeql' and not exists (select 1 from evidence b where b.scanner = 'astgrep' and a.repo is not distinct from b.repo and a.file is not distinct from b.file and a.rule_id is not distinct from b.rule_id)")
def _(spark, d):
    side = lambda s: _evidence(spark, d).where(F.col("scanner") == s).select("repo", "file", "rule_id").distinct()
    return side("codeql").subtract(side("astgrep"))


@query(
    "c27_file_roles",
    f"select repo, trim(replace(file, '\\', '/')) as path, coalesce({_list(BUCKETS)}[min(nullif(list_position({_list(BUCKETS)}, bucket), 0))], 'other') as role, count(*) as n, min(evidence_id) as first from evidence where file is not null group by 1, 2",
)
def _(spark, d):
    return verify.file_roles(_evidence(spark, d))


@query("c28_trusted_arm", f"with p as (select repo, scanner, count(*) as n, list_position({_list(verify.ARMS)}, scanner) as o from evidence where scanner in {_in(verify.ARMS)} group by 1, 2) select repo, scanner, n from (select *, row_number() over (partition by repo order by o) as rn from p) where rn = 1")
def _(spark, d):
    return verify.trusted_arm(_evidence(spark, d))


@query(
    "c29_fallback",
    f"with {_FILE}, own as (select repo, path, arg_max(sha256(content), file_id) filter (content is not null) as own from f group by 1, 2), k as (select repo, path, sha256 as stored from (select *, row_number() over (partition by repo, path order by snapshot_no desc, loaded_at desc, sha256 desc nulls last) as rn from file_signatures) where rn = 1) "
    "select own.repo, own.path, coalesce(stored, own) as sha256, case when stored is not null then 'stored' when own is not null then 'computed' else 'none' end as source from own left join k on own.repo = k.repo and own.path = k.path",
)
def _(spark, d):
    return verify.with_fallback(_files(spark, d).where("content is not null").unionByName(_files(spark, d).where("content is null").withColumn("file_id", -F.col("file_id"))), table(spark, d, "file_signatures"))


@query(
    "d16_slices",
    f"with {_GROUPABLE}, {_TOKENS}, m as (select repo, split_part(path, '/', 1) as module, cast(sum(tokens) as bigint) as t from t group by 1, 2), p as (select repo, count(*) as n, cast(sum(t) as bigint) as total, cast(floor(sum(t) / count(*)) as bigint) as mean, max(t) as largest from m group by 1) "
    "select *, concat_ws('; ', case when largest > 1500 then 'slice over threshold' end, case when largest > 4 * mean then 'lopsided slices' end, case when n = 1 then 'single slice' end) as warnings from p",
)
def _(spark, d):
    return verify.slices(inventory.tokens_of(_files(spark, d)), 1500)


@query("d25_python_metrics", None)
def _(spark, d):
    return verify.python_metrics(_files(spark, d))


@query("d36_token_classes", None)
def _(spark, d):
    return verify.token_classes(_files(spark, d))


@query("d37_tag_totals", "with t as (select coalesce(text, '') as text from documents) " + " union all ".join(f"select '{k}' as tag, cast(sum(len(regexp_extract_all(text, '{p}'))) as bigint) as n from t" for k, p in documents.TAGS.items()))
def _(spark, d):
    rows = documents.tag_counts(table(spark, d, "documents"))
    each = F.explode(F.create_map(*[x for k in documents.TAGS for x in (F.lit(k), F.col(k))]))
    return rows.select(each.alias("tag", "k")).groupBy("tag").agg(F.sum("k").alias("n"))


@query(
    "e13_resolvable",
    rf"with {_FILE}, n as (select repo, path, arg_max(content, file_id) filter (content is not null) as content from f group by 1, 2) select e.repo, count(*) as n, count(*) filter (line between 1 and len(string_split(content, chr(10)))) as n_inside from evidence e join n on e.repo = n.repo and trim(replace(e.file, '\', '/')) = n.path where content is not null group by 1",
)
def _(spark, d):
    rows = _evidence(spark, d).where("file is not null").select("repo", T.posix(F.col("file")).alias("path"), "line")
    text = inventory.with_path(_files(spark, d)).where("content is not null").groupBy("repo", "path").agg(F.max_by(F.size(F.split("content", "\n")), "file_id").alias("n_lines"))
    return rows.join(text, ["repo", "path"]).groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.col("line").between(1, F.col("n_lines"))).alias("n_inside"))


@query(
    "f5_scaling",
    f"with {_pairs('cite_snapshots', 'x.rule_id')}, n as (select snapshot_no, rule_id, count(*) filter (o) as was, count(*) filter (not o) as now from (select *, true as o from old union all select *, false as o from new) where rule_id is not null group by 1, 2) select * from n where now <> was",
)
def _(spark, d):
    old, new = diff.neighbours(table(spark, d, "cite_snapshots"))
    n = lambda x: x.where("rule_id is not null").groupBy("snapshot_no", "rule_id").agg(F.count("*").alias("n"))
    return verify.scaling(n(old), n(new), 1, ["snapshot_no", "rule_id"])


@query("f8_intersection", "select repo, path from (select distinct repo, trim(replace(rel_path, '\\', '/')) as path from files intersect select distinct repo, path from file_signatures)")
def _(spark, d):
    return inventory.with_path(_files(spark, d)).select("repo", "path").intersect(table(spark, d, "file_signatures").select("repo", "path"))


@query("g8_supertypes", None)
def _(spark, d):
    return verify.supertypes(_files(spark, d))


@query(
    "g13_er_diagrams",
    f"with {_FILE}, {_ENT}, u as (select distinct repo, class_name, \"table\" from e where repo is not null) select repo, 'erDiagram' || chr(10) || string_agg('  ' || class_name || ' {{ string table \"' || \"table\" || '\" }}', chr(10) order by class_name, \"table\") as diagram from u group by 1",
)
def _(spark, d):
    rows = entities.entities(_files(spark, d)).where("repo is not null").select("repo", "class_name", "table").distinct()
    line = F.concat(F.lit("  "), "class_name", F.lit(' { string table "'), "table", F.lit('" }'))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_name", "table", line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy("repo").agg(F.concat(F.lit("erDiagram\n"), lines).alias("diagram"))


@query("h21_stamps", "select repo, strftime(min(committed_at), '%Y-%m-%dT%H:%M:%SZ') as first_commit, strftime(max(committed_at), '%Y-%m-%dT%H:%M:%SZ') as last_commit, count(*) filter (loaded_at < committed_at) as n_early from files where repo is not null group by 1")
def _(spark, d):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _files(spark, d).where("repo is not null").groupBy("repo").agg(iso(F.min("committed_at")).alias("first_commit"), iso(F.max("committed_at")).alias("last_commit"), F.count_if(F.col("loaded_at") < F.col("committed_at")).alias("n_early"))


@query("j9_refold", None)
def _(spark, d):
    folded = gates.certification_fold(table(spark, d, "artifacts"))
    said = table(spark, d, "artifacts").where("artifact = 'certification.json'").select("artifact_id", F.get_json_object("payload", "$.certified").alias("said"))
    return folded.join(said, "artifact_id", "left").groupBy(F.col("certified").alias("refolded"), "said").agg(F.count("*").alias("n"))


@query(
    "j16_claims",
    rf"with {_FILE}, n as (select repo, path, arg_max(coalesce(content, ''), file_id) as content, arg_max(sha256(content), file_id) as sha from f group by 1, 2), c as (select repo, trim(replace(file, '\', '/')) as path from evidence where file is not null), p as (select c.repo, c.path, content, k.predicate from c left join n on c.repo = n.repo and c.path = n.path, (select unnest(['path_exists', 'path_absent', 'contains', 'not_contains']) as predicate) k) "
    "select predicate, case predicate when 'path_exists' then content is not null when 'path_absent' then content is null when 'contains' then content is not null and contains(content, 'class') else content is not null and not contains(content, 'class') end as ok, count(*) as n from p group by 1, 2",
)
def _(spark, d):
    rows = _evidence(spark, d).where("file is not null").select(F.col("evidence_id").alias("claim_id"), "repo", T.posix(F.col("file")).alias("path"), F.lit("class").alias("needle"))
    kinds = F.explode(F.array(*map(F.lit, ("path_exists", "path_absent", "contains", "not_contains"))))
    return verify.claims_hold(rows.withColumn("predicate", kinds), _files(spark, d)).groupBy("predicate", "ok").agg(F.count("*").alias("n"))


@query("j17_denied", "select file_id, token, n from (select file_id, token, cast((length(lower(content)) - length(replace(lower(content), token, ''))) / length(token) as int) as n from files, (select unnest(['.invalid', 'farwater']) as token) where content is not null) where n > 0")
def _(spark, d):
    return verify.denied(_files(spark, d), [".invalid", "farwater"])


@query("v1_annotation_rows", None)
def _(spark, d):
    return typed.annotation_rows(*typed.from_sources(_files(spark, d)), typed.catalogue(spark))


@query("v1_rule_counts", None)
def _(spark, d):
    return QUERIES["v1_annotation_rows"](spark, d).groupBy("rule_id", "framework", "generation", "source_set").agg(F.count("*").alias("n"))


@query("sg_findings", None)
def _(spark, d):
    return typed.findings(_files(spark, d))
