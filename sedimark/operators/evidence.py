"""Evidence rows: rules over source lines, extraction from build and configuration files, merging, counting, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.text import bucket_of, posix
from sedimark.operators.inventory import with_path

#: Evidence buckets in their order.
BUCKETS = ("api_surface", "configuration", "deployment", "error_handling", "messaging", "observability", "outbound_clients", "persistence", "raw_queries", "references", "security", "testing")

#: Rule ids and what they match in a line of Java.
RULES = {
    "api_surface__controller": r"@(RestController|Controller)\b",
    "api_surface__mapping": r"@(Get|Post|Put|Patch|Delete|Request)Mapping\b",
    "outbound_clients__feign": r"@FeignClient\(",
    "outbound_clients__import": r"^\s*import .*\.(RestTemplate|WebClient|RestClient)(;|\.)",
    "outbound_clients__type_usage": r"\b(RestTemplate|WebClient|RestClient)\s+[A-Za-z_]",
    "messaging__listener": r"@(Kafka|Rabbit|Jms|Sqs)Listener\b",
    "messaging__import": r"^\s*import .*\.(KafkaTemplate|RabbitTemplate|JmsTemplate|SqsTemplate)(;|\.)",
    "messaging__type_usage": r"\b(KafkaTemplate|RabbitTemplate|JmsTemplate|SqsTemplate)\s*[<A-Za-z_]",
    "persistence__entity": r"^\s*@Entity\s*$",
    "persistence__repository": r"\binterface\s+\w+\s+extends\s+.*\b(JpaRepository|CrudRepository|PagingAndSortingRepository|MongoRepository|ReactiveCrudRepository)\s*<",
    "persistence__column": r"@Column\b",
    "persistence__join_column": r"@(JoinColumn|JoinTable)\b",
    "persistence__relation": r"@(ManyToOne|OneToMany|ManyToMany|OneToOne)\b",
    "persistence__id": r"@(Id|EmbeddedId|GeneratedValue)\b",
    "persistence__transactional": r"@Transactional\b",
    "raw_queries__query": r"@Query\(",
    "security__method": r"@(PreAuthorize|PostAuthorize|Secured|RolesAllowed)\b",
    "security__config": r"@(EnableWebSecurity|EnableMethodSecurity)\b",
    "security__filterchain_type": r"\bSecurityFilterChain\b",
    "configuration__properties": r"@(ConfigurationProperties\b|Value\()",
    "error_handling__advice": r"@(ControllerAdvice|RestControllerAdvice|ExceptionHandler)\b",
    "observability__timed": r"@Timed\b",
    "observability__meterregistry_type": r"\bMeterRegistry\b",
    "observability__import": r"^\s*import (io\.micrometer|io\.opentelemetry)\.",
    "testing__springboottest": r"@SpringBootTest\b",
    "testing__import": r"^\s*import (org\.testcontainers|org\.springframework\.boot\.test|org\.springframework\.test|org\.junit|org\.mockito)\.",
    "references__import": r"^\s*import\s",
    "references__package": r"^\s*package\s",
    "references__stereotype": r"@(Service|Component|Repository|Configuration)\b",
}
#: Gradle configurations, and the families whose absence is claimed with the buckets and dependencies that speak for them.
GRADLE_CONFIGURATIONS = "implementation|api|compileOnly|runtimeOnly|testImplementation|testCompileOnly|testRuntimeOnly|compile|runtime|provided|compileClasspath|runtimeClasspath|testCompileClasspath|testRuntimeClasspath|annotationProcessor|developmentOnly"
FAMILIES = {
    "messaging": (("messaging",), "kafka|rabbit|amqp|jms"),
    "redis": (("observability", "configuration", "outbound_clients"), "redis"),
    "feign": (("outbound_clients",), "feign|openfeign"),
    "actuator": (("observability", "configuration"), "actuator"),
    "aws_secrets": (("configuration", "security"), "secretsmanager|aws.?secrets"),
    "security": (("security",), r"spring-boot-starter-security|springframework\.security"),
    "config": (("configuration",), None),
}


def lines_of(files: DataFrame, *keep: str) -> DataFrame:
    """One row for each line of each content: line (from 1) and text, carriage returns and a byte order mark left out."""
    text = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r", "")
    return files.where("content is not null").select(*keep, F.posexplode(F.split(text, "\n")).alias("at", "text")).select(*keep, (F.col("at") + 1).alias("line"), "text")


def rule_hits(files: DataFrame) -> DataFrame:
    """(file_id, repo, file, line, rule_id, match): every rule that matches a line of a Java file.

    All rules are one expression over the line; lines that hold none of the rules' literals are dropped before.
    """
    java = with_path(files).where(F.col("path").endswith(".java"))
    lines = lines_of(java, "file_id", "repo", "path").where(F.col("text").rlike(r"@[A-Z]|^\s*(import|package)\s|interface |RestTemplate|WebClient|RestClient|Template|SecurityFilterChain|MeterRegistry"))
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(r)) for r, p in RULES.items()]), lambda x: x.isNotNull())
    return lines.select("file_id", "repo", F.col("path").alias("file"), "line", F.explode(hits).alias("rule_id"), F.substring(F.trim("text"), 1, 200).alias("match"))


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """(file_id, line, configuration, group, name, version) of the dependencies of Gradle scripts; a missing version is null."""
    lines = lines_of(with_path(files).where(F.col("suffix").isin(".gradle") | F.col("base").endswith(".gradle.kts")), "file_id")
    bare = F.regexp_replace("text", r"(^|[^:])//.*$", "$1")
    pattern = rf"\b({GRADLE_CONFIGURATIONS})\s*\(?\s*['\"]([a-zA-Z0-9._\-]+):([a-zA-Z0-9._\-]*):?([a-zA-Z0-9._\-]*)['\"]"
    got = lines.withColumn("text", bare).where(F.col("text").rlike(pattern))
    part = lambda i: F.regexp_extract("text", pattern, i)
    return got.select("file_id", "line", part(1).alias("configuration"), part(2).alias("group"), part(3).alias("name"), F.nullif(part(4), F.lit("")).alias("version"))


def gradle_plugins(files: DataFrame) -> DataFrame:
    """(file_id, line, plugin_id, version) of plugins by id; the version of an unversioned one is null."""
    lines = lines_of(with_path(files).where(F.col("suffix") == ".gradle"), "file_id")
    pattern = r"\bid\s*\(?\s*['\"]([a-zA-Z0-9._\-]+)['\"]\s*\)?(?:\s+version\s+['\"]([^'\"]+)['\"])?"
    got = lines.where(F.col("text").rlike(pattern))
    return got.select("file_id", "line", F.regexp_extract("text", pattern, 1).alias("plugin_id"), F.nullif(F.regexp_extract("text", pattern, 2), F.lit("")).alias("version"))


def property_keys(files: DataFrame) -> DataFrame:
    """(file_id, key): the keys of .properties files; comments and lines without : or = give none."""
    lines = lines_of(with_path(files).where(F.col("suffix") == ".properties"), "file_id")
    pattern = r"^\s*([\w.\-]+)\s*[:=]"
    return lines.where(F.col("text").rlike(pattern) & ~F.col("text").rlike(r"^\s*[#!]")).select("file_id", F.regexp_extract("text", pattern, 1).alias("key")).distinct()


def yaml_keys(files: DataFrame) -> DataFrame:
    """(file_id, key): dotted keys of the leaves of .yml files, by a stack of indentations folded over the lines.

    List items and lines that are no key are skipped; only keys with a value on their line are leaves.
    """
    rows = with_path(files).where(F.col("suffix").isin(".yml", ".yaml") & F.col("content").isNotNull())
    pattern = r"^(\s*)([\w.\-]+|\"[^\"]*\"|'[^']*')\s*:\s*(.*)$"
    lines = F.filter(F.split(F.regexp_replace("content", "\r", ""), "\n"), lambda x: x.rlike(pattern) & ~F.ltrim(x).startswith("-") & ~F.ltrim(x).startswith("#"))
    parsed = F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, pattern, 1)).alias("i"), F.regexp_replace(F.regexp_extract(x, pattern, 2), r"^[\"']|[\"']$", "").alias("k"), F.trim(F.regexp_extract(x, pattern, 3)).alias("v")))
    start = F.struct(F.expr("cast(array() as array<struct<i:int,k:string>>)").alias("stack"), F.expr("cast(array() as array<string>)").alias("keys"))

    def step(state: Column, x: Column) -> Column:
        open_ = F.filter(state["stack"], lambda s: s["i"] < x["i"])
        leaf = (x["v"] != "") & ~x["v"].startswith("#")
        path = F.array_join(F.concat(F.transform(open_, lambda s: s["k"]), F.array(x["k"])), ".")
        pushed = F.concat(open_, F.array(F.struct(x["i"].alias("i"), x["k"].alias("k"))))
        return F.struct(F.when(leaf, open_).otherwise(pushed).alias("stack"), F.when(leaf, F.concat(state["keys"], F.array(path))).otherwise(state["keys"]).alias("keys"))

    return rows.select("file_id", F.explode(F.aggregate(parsed, start, step, lambda s: s["keys"])).alias("key")).distinct()


def key_sets(config_key_sets: DataFrame) -> DataFrame:
    """(repo, file, keys): the distinct keys of a file from all its rows, sorted; null arrays add none."""
    rows = config_key_sets.select("repo", posix(F.col("file")).alias("file"), F.explode_outer("keys").alias("key")).distinct()
    return rows.groupBy("repo", "file").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def first_seen(evidence: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Of rows that agree in `keys` (nulls agree) the first by `order`, with the columns `keep`; aggregated map-side."""
    first = F.min(F.struct(*order, *[c for c in keep if c not in order]))
    return evidence.groupBy(*keys).agg(first.alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in keep])


def facts(evidence: DataFrame) -> DataFrame:
    """One fact for each row with a file: predicate (rule or EVIDENCE), subject, object, qualifiers as JSON, place and scanner."""
    return evidence.where("file is not null").select(
        F.coalesce("rule_id", F.lit("EVIDENCE")).alias("predicate"), posix(F.col("file")).alias("subject"), F.col("match").alias("object"),
        F.concat(F.lit('{"bucket":"'), F.coalesce("bucket", F.lit("")), F.lit('"}')).alias("qualifiers"), "line", "scanner", "evidence_id",
    )


def rollup_counts(evidence: DataFrame) -> DataFrame:
    """(bucket, rule_id, level, n): rows by bucket and rule, by bucket, and in all; level is the number of rolled up columns."""
    return evidence.rollup("bucket", "rule_id").agg((F.grouping("bucket") + F.grouping("rule_id")).cast("int").alias("level"), F.count("*").alias("n"))


def emit_counts(evidence: DataFrame) -> DataFrame:
    """D3: conditional counts of rows by scanner and bucket kind, one row for each repo."""
    n = lambda c: F.count_if(F.expr(c))
    return evidence.groupBy("repo").agg(
        F.count("*").alias("n_rows"), n("rule_id is null").alias("n_unruled"), n("line is null").alias("n_unplaced"), n("scanner = 'codeql'").alias("n_codeql"),
        n("scanner = 'astgrep'").alias("n_astgrep"), n("bucket = 'references'").alias("n_references"), n("match is null").alias("n_unmatched"),
    )


def round_robin(evidence: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows, taken in turn from each bucket by (src_ord, row_ord); null buckets come last.

    Only each bucket's first `limit` rows can be taken, and each task keeps no more of them.
    """
    w = Window.partitionBy("bucket").orderBy("src_ord", "row_ord", "evidence_id")
    head = evidence.select("bucket", "src_ord", "row_ord", "evidence_id").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    return head.orderBy("turn", F.col("bucket").asc_nulls_last(), "evidence_id").limit(limit).select("evidence_id", "bucket", "turn")


def family_claims(evidence: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """(by, family, predicate, witness): families without a positive row, ABSENCE where a witness makes the trial callable, else UNPROVEN.

    Witness: the smallest file of a deployment row that names the family; of the configuration family the smallest file with keys.
    Rows with a null in `by` are left out.
    """
    rows = evidence.dropna(subset=by)
    hay = F.lower(F.coalesce("match", F.lit("")))
    agg = []
    for f, (buckets, dep) in FAMILIES.items():
        agg.append(F.count_if(F.col("bucket").isin(*buckets)).alias(f"h_{f}"))
        if dep:
            agg.append(F.min(F.when((F.col("bucket") == "deployment") & hay.rlike(dep), posix(F.col("file")))).alias(f"w_{f}"))
    per = rows.groupBy(*by).agg(*agg)
    known = keys.where("size(keys) > 0").groupBy(*by).agg(F.min(posix(F.col("file"))).alias("w_config"))
    per = per.join(known, by, "left")
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"h_{f}").alias("hits"), F.col(f"w_{f}").alias("witness")) for f in FAMILIES])
    out = per.select(*by, F.explode(each).alias("f")).where("f.hits = 0")
    return out.select(*by, "f.family", F.when(F.col("f.witness").isNotNull(), "ABSENCE").otherwise("UNPROVEN").alias("predicate"), "f.witness")


def family_support(evidence: DataFrame) -> DataFrame:
    """(repo, family, n_dependencies, supported): families that a deployment row of a repo names, and 1 where code has rows of them."""
    hay = F.lower(F.concat_ws(" ", "match", "rule_id", "file"))
    rows = evidence.where("repo is not null")
    agg = []
    for f, (buckets, dep) in FAMILIES.items():
        if dep:
            agg += [F.count_if((F.col("bucket") == "deployment") & hay.rlike(dep)).alias(f"d_{f}"), F.count_if(F.col("bucket").isin(*buckets)).alias(f"h_{f}")]
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"d_{f}").alias("n"), F.col(f"h_{f}").alias("h")) for f, (_, dep) in FAMILIES.items() if dep])
    out = rows.groupBy("repo").agg(*agg).select("repo", F.explode(each).alias("e")).where("e.n > 0")
    return out.select("repo", "e.family", F.col("e.n").alias("n_dependencies"), F.when(F.col("e.h") > 0, 1).otherwise(0).alias("supported"))


def unknown_buckets(evidence: DataFrame) -> DataFrame:
    """(rule_id, n): rules whose prefix is no bucket, which a strict run would refuse."""
    return evidence.where("rule_id is not null").where(~bucket_of(F.col("rule_id")).isin(*BUCKETS)).groupBy("rule_id").agg(F.count("*").alias("n"))


def located(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """(evidence_id, source_line): rows whose file is in the inventory, with the line they name; null beyond the end.

    Of a file delivered more than once the greatest file_id counts. Every file is split once (`verify.with_lines`).
    """
    from sedimark.operators.verify import with_lines

    rows = evidence.where("file is not null and repo is not null").select("evidence_id", "repo", posix(F.col("file")).alias("path"), "line")
    return with_lines(rows, files).select("evidence_id", F.col("near").alias("source_line"))
