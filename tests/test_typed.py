"""The typed rule pack on small relations."""

from sedimark.operators import graph, typed


def _tables(spark):
    elements = spark.createDataFrame(
        [(1, "class", "A", "m/src/main/java/a/A.java", 1, 9, 1, None, "a", "A", None), (2, "method", "get", "m/src/main/java/a/A.java", 3, 5, 1, 1, "a", None, None), (3, "class", "G", "build/generated/src/main/java/a/G.java", 1, 2, 1, None, "a", "G", None), (4, "field", None, "m/src/test/java/T.java", 2, 2, 1, None, None, None, None)],
        "id bigint, kind string, name string, file string, start_line int, end_line int, start_col int, parent_id bigint, package string, nested_name string, type_id bigint",
    )
    marks = spark.createDataFrame(
        [(10, 1, "jakarta.persistence", "Table", None), (11, 2, "org.springframework.web.bind.annotation", "GetMapping", None), (12, 3, "jakarta.persistence", "Entity", None), (13, 4, "javax.persistence", "Id", None), (14, 1, "x", "Container", None), (15, None, "jakarta.persistence", "Entity", 14), (16, 1, "other", "Table", None)],
        "id bigint, owner_id bigint, type_pkg string, type_name string, container_id bigint",
    )
    attrs = spark.createDataFrame(
        [(10, "name", 0, 1, 1, "a_table", None, None, None, None), (11, "value", 1, 3, 9, "/b", None, None, None, None), (11, "value", 0, 3, 2, "/a", None, None, None, None), (11, "name", 0, 3, 1, "n", None, None, None, None), (11, "path", 0, 3, 1, "", None, None, None, None)],
        "ann_id bigint, attr string, ord int, line int, col int, str_value string, bool_value boolean, field_name string, field_type string, type_fqn string",
    )
    return elements, marks, attrs


def test_rows_are_total_and_ordered(spark):
    got = {(r.rule_id, r.generation, r.symbol, r.signal, r.detail, r.source_set) for r in typed.annotation_rows(*_tables(spark), typed.catalogue(spark)).collect()}
    assert got == {
        ("jpa__table", "current", "a.A", "@Table", "a_table", "main"), ("spring__mapping", "current", "a.A#get", "@GetMapping", "/a|/b", "main"),
        ("jpa__id", "legacy", "m/src/test/java/T.java", "@Id", "", "test"), ("jpa__entity", "current", "a.A", "@Entity", "", "main"),
    }


def test_arguments_through_intermediates(spark):
    reach = graph.closure(spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint"))
    args = spark.createDataFrame([(2, "Root", 0, "a.Owner"), (3, "Root", 1, "Long")], "type_id bigint, root_name string, idx int, arg_fqn string")
    got = typed.bound_arguments(spark.createDataFrame([(1,), (3,)], "type_id bigint"), reach, args)
    assert {tuple(r) for r in got.collect()} == {(1, "Root", 0, "a.Owner"), (1, "Root", 1, "Long"), (3, "Root", 1, "Long")}


def test_jakarta_states(spark):
    rows = spark.createDataFrame([("f", 1, "javax.persistence", "Entity"), ("f", 2, "jakarta.ws.rs.core", "X"), ("f", 3, "javax.sql", "DataSource"), ("f", 1, "javax.persistence", "Entity")], "file string, line int, pkg string, type_name string")
    assert {(r.line, r.rule_id) for r in typed.jakarta_rows(rows).collect()} == {(1, "jakarta__pending_import"), (2, "jakarta__migrated_import")}
    assert typed.jakarta_rows(rows).count() == 2


def test_findings_by_presence_and_absence(spark):
    cols = "file_id bigint, rel_path string, content string"
    rows = [(1, "A.java", "@Entity\nclass A {}"), (2, "B.java", "@Entity\nclass B { @Version int v; }"), (3, "T.java", "class T { @Test void a() { Thread.sleep(1); } }"), (4, "U.java", "class U { @Test void a() { assertTrue(x); verify(y); } }"), (5, "V.java", None)]
    got = {tuple(r) for r in typed.findings(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(1, "architecture__entity_no_version_field"), (3, "testing__test_method_no_assertion"), (3, "testing__thread_sleep_in_test")}
