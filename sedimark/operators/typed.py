"""The typed rule pack: rows of eleven columns from relations of a syntax tree (elements, annotations, attributes, imports).

Every helper is total: it adds columns by left joins and gives an empty string where there is nothing, so no row is lost to a
missing attribute. Results are sets. Frameworks and generations come from a catalogue table joined when rows are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.text import java_package, source_set
from sedimark.operators.evidence import lines_of
from sedimark.operators.inventory import with_path

#: Annotation signatures (framework, package, name, kind, generation).
SIGNATURES = (
    [("jpa", p + ".persistence", n, k, g) for p, g in (("javax", "legacy"), ("jakarta", "current")) for n, k in (("Entity", "entity"), ("Table", "table"), ("Column", "column"), ("JoinColumn", "join_column"), ("Id", "id"), ("EmbeddedId", "id"), ("GeneratedValue", "id"), ("ManyToOne", "relation"), ("OneToMany", "relation"), ("ManyToMany", "relation"), ("OneToOne", "relation"))]
    + [("spring", "org.springframework.web.bind.annotation", n + "Mapping", "mapping", "current") for n in ("Get", "Post", "Put", "Patch", "Delete", "Request")]
    + [("spring", "org.springframework.stereotype", n, "stereotype", "current") for n in ("Service", "Component", "Repository", "Controller")]
    + [("spring", "org.springframework.web.bind.annotation", n, "controller", "current") for n in ("RestController", "ControllerAdvice", "RestControllerAdvice", "ExceptionHandler")]
    + [("spring", "org.springframework.data.jpa.repository", "Query", "query", "current"), ("spring", "org.springframework.security.access.prepost", "PreAuthorize", "method", "current"), ("spring", "org.springframework.beans.factory.annotation", "Value", "value", "current")]
)
#: Javax namespaces that moved to jakarta.
RELOCATED = ("persistence", "validation", "servlet", "annotation", "transaction", "jms", "ws.rs", "inject", "mail", "xml.bind", "json", "websocket")
COLUMNS = ("file", "start_line", "end_line", "source_set", "schema_version", "rule_id", "framework", "generation", "symbol", "signal", "detail")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SIGNATURES), "framework string, type_pkg string, type_name string, kind string, generation string")


def effective_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations on their owners; one that stands in a container (container_id) belongs to the container's owner."""
    outer = annotations.select(F.col("id").alias("container_id"), F.col("owner_id").alias("outer_owner"))
    met = annotations.join(outer, "container_id", "left")
    return met.select("id", F.coalesce("outer_owner", "owner_id").alias("owner_id"), "type_pkg", "type_name", "container_id").distinct()


def attribute(attrs: DataFrame, names: list[str], to: str, sep: str = "|") -> DataFrame:
    """(ann_id, to): the values of the first of `names` that is not empty, in order of place, joined by `sep`."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("attr"))
    value = F.coalesce("str_value", "field_name", "type_fqn", F.col("bool_value").cast("string"))
    rows = attrs.where(rank > 0).select("ann_id", rank.alias("r"), F.struct("ord", "line", "col", value.alias("v")).alias("s")).where("coalesce(s.v, '') <> ''")
    per = rows.groupBy("ann_id", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["v"]), sep).alias("v"))
    return per.groupBy("ann_id").agg(F.min_by("v", "r").alias(to))


def symbols(elements: DataFrame) -> DataFrame:
    """(id, symbol) in four tiers: a type by package and nested name, a member by its owner's, else the owner's symbol, else the file."""
    own = elements.select("id", "kind", "name", "file", "parent_id", "package", "nested_name")
    up = own.select(F.col("id").alias("parent_id"), F.col("package").alias("p_package"), F.col("nested_name").alias("p_nested"))
    met = own.join(up, "parent_id", "left")
    dotted = lambda p, n: F.when(F.coalesce(n, F.lit("")) == "", F.lit(None)).when(F.coalesce(p, F.lit("")) == "", n).otherwise(F.concat_ws(".", p, n))
    type_, owner = dotted(F.col("package"), F.col("nested_name")), dotted(F.col("p_package"), F.col("p_nested"))
    member = F.when(owner.isNotNull() & (F.coalesce("name", F.lit("")) != ""), F.concat_ws("#", owner, "name"))
    return met.select("id", F.coalesce(F.when(F.col("kind").isin("class", "interface", "enum", "record"), type_), member, owner, F.col("file"), F.lit("")).alias("symbol"))


def annotation_rows(elements: DataFrame, annotations: DataFrame, attrs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The v1 rows of annotations in a known source set: rule framework__kind, the annotation as signal, its value, path or name as detail."""
    marks = effective_annotations(annotations).join(signatures, ["type_pkg", "type_name"])
    detail = attribute(attrs, ["path", "value", "name"], "detail")
    rows = marks.join(elements.select(F.col("id").alias("owner_id"), "file", "start_line", "end_line"), "owner_id").join(symbols(elements).withColumnRenamed("id", "owner_id"), "owner_id")
    rows = rows.join(detail.withColumnRenamed("ann_id", "id"), "id", "left")
    out = rows.withColumns({"source_set": source_set(F.col("file")), "schema_version": F.lit("v1"), "rule_id": F.concat_ws("__", "framework", "kind"), "signal": F.concat(F.lit("@"), "type_name"), "detail": F.coalesce("detail", F.lit(""))})
    return out.where("source_set is not null").select(*COLUMNS).distinct()


def jakarta_rows(imports: DataFrame) -> DataFrame:
    """(file, line, rule_id, pkg, type_name): imports of relocated namespaces, pending under javax and migrated under jakarta."""
    moved = "|".join(x.replace(".", r"\.") for x in RELOCATED)
    state = F.when(F.col("pkg").rlike(rf"^javax\.({moved})(\.|$)"), "jakarta__pending_import").when(F.col("pkg").rlike(rf"^jakarta\.({moved})(\.|$)"), "jakarta__migrated_import")
    return imports.select("file", "line", state.alias("rule_id"), "pkg", "type_name").where("rule_id is not null").distinct()


def bound_arguments(candidates: DataFrame, reach: DataFrame, type_args: DataFrame) -> DataFrame:
    """(type_id, root_name, idx, arg_fqn): type arguments bound to a root by a type itself or by what it reaches (src, dst)."""
    own = candidates.select("type_id", F.col("type_id").alias("at"))
    above = candidates.join(reach, F.col("type_id") == F.col("src")).select("type_id", F.col("dst").alias("at"))
    return own.unionByName(above).distinct().join(type_args.withColumnRenamed("type_id", "at"), "at").select("type_id", "root_name", "idx", "arg_fqn").distinct()


def from_sources(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements, annotations, attributes) of Java files as far as lines tell: a file's first type, annotations that begin a line, and
    their literals. An annotation's package is taken from a table of signatures by its name, current generation first.
    """
    java = with_path(files).where(F.col("path").endswith(".java") & F.col("content").isNotNull())
    name = F.regexp_extract("content", r"\b(?:class|interface|enum|record)\s+(\w+)", 1)
    kind = F.regexp_extract("content", r"\b(class|interface|enum|record)\s+\w+", 1)
    size = F.size(F.split("content", "\n"))
    base = java.select(F.col("file_id").alias("id"), kind.alias("kind"), name.alias("name"), F.col("path").alias("file"), F.lit(1).alias("start_line"), size.alias("end_line"), F.lit(None).cast("bigint").alias("parent_id"), F.nullif(java_package(F.col("content")), F.lit("")).alias("package"), name.alias("nested_name"))
    found = lines_of(java, "file_id").where(F.col("text").rlike(r"^\s*@[A-Z]\w*"))
    rows = found.select((F.col("file_id") * 100_000 + F.col("line")).alias("id"), F.col("file_id").alias("owner_id"), F.regexp_extract("text", r"^\s*@(\w+)", 1).alias("type_name"), "line", "text")
    packages = catalogue(files.sparkSession).where("generation = 'current'").select("type_name", "type_pkg").distinct()
    marks = rows.join(packages, "type_name").select("id", "owner_id", "type_pkg", "type_name", F.lit(None).cast("bigint").alias("container_id"))
    literal = F.regexp_extract("text", r'(?:(?:path|value|name)\s*=\s*)?"([^"]*)"', 1)
    attr = F.coalesce(F.nullif(F.regexp_extract("text", r'\b(path|value|name)\s*=\s*"', 1), F.lit("")), F.lit("value"))
    none = lambda t: F.lit(None).cast(t)
    values = rows.where(F.col("text").rlike('"')).select(F.col("id").alias("ann_id"), attr.alias("attr"), F.lit(0).alias("ord"), "line", F.lit(0).alias("col"), literal.alias("str_value"), none("boolean").alias("bool_value"), none("string").alias("field_name"), none("string").alias("field_type"), none("string").alias("type_fqn"))
    return base, marks, values


#: Structural findings of whole files: what must be there, and what must not.
FINDINGS = {
    "architecture__entity_no_version_field": (r"(?m)^\s*@Entity\b", r"@Version\b"),
    "architecture__scheduled_and_listener_same_class": (r"@Scheduled\b[\s\S]*@KafkaListener\b|@KafkaListener\b[\s\S]*@Scheduled\b", None),
    "architecture__native_query_string_concatenation": (r"createNativeQuery\([^;]*\+", None),
    "architecture__client_default_no_timeout": (r"new RestTemplate\(\)", r"setConnectTimeout|setReadTimeout"),
    "architecture__unbounded_findall_exposed": (r"@(Get|Request)Mapping[\s\S]*\.findAll\(\)", r"Pageable"),
    "testing__test_method_no_assertion": (r"@Test\b", r"\bassert\w*\s*\(|\bverify\s*\(|expect"),
    "testing__disabled_test_method": (r"@(Disabled|Ignore)\b", None),
    "testing__empty_catch_in_test": (r"@Test[\s\S]*catch\s*\([^)]*\)\s*\{\s*\}", None),
    "testing__thread_sleep_in_test": (r"@Test[\s\S]*Thread\.sleep\(", None),
    "testing__verify_no_assertion": (r"@Test[\s\S]*\bverify\s*\(", r"\bassert\w*\s*\("),
}


def findings(files: DataFrame) -> DataFrame:
    """(file_id, rule_id): co-occurrence and absence findings of Java files, by what the text holds and lacks."""
    java = with_path(files).where(F.col("path").endswith(".java") & F.col("content").isNotNull())
    test = lambda has, lacks: F.col("content").rlike(has) & (~F.col("content").rlike(lacks) if lacks else F.lit(True))
    hits = F.filter(F.array(*[F.when(test(*p), F.lit(r)) for r, p in FINDINGS.items()]), lambda x: x.isNotNull())
    return java.select("file_id", F.explode(hits).alias("rule_id"))
