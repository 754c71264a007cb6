"""Facts, measures, gates and their helpers on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from sedimark.engine import Engine, Settings
from sedimark.functions.ordered import range_index
from sedimark.operators import documents, gates, graph, inventory, ledger, verify
from sedimark.session import bounded, is_small


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def java(spark):
    schema = "file_id bigint, repo string, rel_path string, content string"
    return spark.createDataFrame([
        (1, "r", "a/src/InvoiceRepo.java", "package a.b;\ninterface InvoiceRepo extends Base, JpaRepository< Invoice , java.util.UUID > {}\n"),
        (2, "r", "a/src/Plain.java", 'package a;\nclass Plain { // TODO one\n  String u = "http://x"; /* FIXME\n two */ }\n'),
        (3, "r", "a/build/Out.java", "// TODO never swept"), (4, "r", "gradlew", "#!/bin/sh"), (5, "r", "m/pom.xml", "<project/>"), (6, "s", "m/pom.xml", None), (7, None, "x.py", "def f(a: int) -> int:\n    '''d'''\n    return a\ndef g(b): pass\n"),
    ], schema)


def test_extraction(spark, java):
    assert _rows(ledger.repositories(java), "repository", "entity", "id_type") == [("InvoiceRepo", "Invoice", "java.util.UUID")]
    assert _rows(ledger.todo_sweep(java), "path", "line", "marker") == [("a/src/Plain.java", 2, "TODO"), ("a/src/Plain.java", 3, "FIXME")]
    assert ledger.todo_sweep(java, 1).count() == 1
    assert _rows(ledger.build_command(java)) == [("r", "gradlew", '"gradlew" --no-daemon clean compileJava compileTestJava'), ("s", "pom.xml", '"mvn" --no-daemon clean compile test-compile')]
    commands = spark.createDataFrame([("mvn test",), ('"C:\\x\\gradlew.bat" build',), ("mvn test; rm x",), ("make all",), (" ",), (None,)], "c string")
    assert [r[0] for r in commands.select(ledger.command_fault(F.col("c"))).collect()] == [None, None, "shell signs", "unknown tool", "empty", "empty"]
    assert _rows(ledger.python_checks(java), "name", "annotated", "documented") == [("f", True, True), ("g", False, False)]
    text = spark.createDataFrame([('a = "// no"; // yes\n/* x\ny */ http://z',)], "t string").select(verify.blank_comments(F.col("t"))).head()[0]
    assert text == 'a = "// no"; ' + " " * 6 + "\n" + " " * 4 + "\n" + " " * 4 + " http://z"


def test_line_ranges_and_decoding(spark):
    one = spark.createDataFrame([(1, "a\r\nb\nc", '["x","y"]', '[["1",null],["2","3"],["short"]]')], "id int, t string, c string, v string")
    assert [r[0] for r in one.select(ledger.line_range(F.col("t"), 2, 5)).collect()] == ["b\nc"]
    assert [r.row for r in ledger.decoded(one.drop("t"), "c", "v").orderBy("nth").collect()] == [{"x": "1", "y": None}, {"x": "2", "y": "3"}]
    assert ledger.without_internal(one.withColumn("_k", F.lit(1))).columns == one.columns


def test_lines_near_and_far(spark):
    text = "\n".join(f"line {i} word{i}abc" for i in range(1, 41))
    files = spark.createDataFrame([(1, "r", "a.java", text), (2, "r", "b.java", None)], "file_id bigint, repo string, rel_path string, content string")
    rows = [(1, "r", "a.java", 5, "word5abc"), (2, "r", "a.java", 5, "word13abc"), (3, "r", "a.java", 5, "word14abc"), (4, "r", "a.java", 99, "nowhere_x"), (5, "r", "b.java", 1, "gone"), (6, "r", "a.java", 40, "word5abc")]
    ev = spark.createDataFrame(rows, "evidence_id bigint, repo string, file string, line int, match string")
    assert dict(_rows(verify.anchors(ev, files))) == {1: "near", 2: "near", 3: "far", 4: "absent", 6: "far"}
    lines = verify.with_lines(ev.withColumnRenamed("file", "path").withColumn("line", F.when(F.col("evidence_id") == 2, F.lit(None)).otherwise(F.col("line"))), files)
    assert {r.evidence_id: r.near for r in lines.collect()} == {1: "line 5 word5abc", 2: None, 3: "line 5 word5abc", 4: None, 6: "line 40 word40abc"}


def test_facts_of_contested_and_single_classes(spark):
    found = spark.createDataFrame([("r", "A", "x.java", "t", "explicit", "p.q"), ("r", "A", "y.java", "u", "explicit", "p"), ("r", "A", "y.java", "u", "explicit", "p"), ("r", "B", "z.java", "v", "inferred", None)], "repo string, class_name string, file string, table string, table_name_source string, package string")
    assert _rows(ledger.maps_to(found), "subject", "object", "status") == [("code spring . B#", "v", "single"), ("code spring . p/A#", "u", "contested"), ("code spring . p/q/A#", "t", "contested")]
    merged = ledger.merged_maps(spark.createDataFrame([("r", "A", 1, "x", "t"), ("r", "A", 0, "y", "u"), ("r", "B", 2, "z", "v")], "repo string, class_name string, src int, file string, table string"))
    assert _rows(merged, "class_name", "src", "file", "status") == [("A", 0, "y", "contested"), ("B", 2, "z", "single")]


def test_provenance(spark):
    results = spark.createDataFrame([("r", i, s) for i, s in enumerate(["confirmed", "unchanged", "confirmed", "drifted", "confirmed"])], "repo string, evidence_id int, status string")
    queries = spark.createDataFrame([("r", 0, "A"), ("r", 1, "B"), ("r", 2, "C"), ("r", 3, "C"), ("r", 4, None)], "repo string, evidence_id int, entity string")
    old = spark.createDataFrame([("r", "A", "a", "single"), ("r", "B", "b", "single"), ("r", "C", "c", "single")], "repo string, entity string, table string, status string")
    new = spark.createDataFrame([("r", "A", "a2", "single"), ("r", "B", "b", "contested")], old.schema)
    assert dict(_rows(ledger.provenance_recheck(results, queries, old, new), "evidence_id", "status")) == {0: "drifted", 1: "contested", 2: "missing", 3: "drifted", 4: "confirmed"}


def test_lineage_by_stratum(spark):
    rows = spark.createDataFrame([("r", "native", "q", True, None, "f", 1), ("r", "native", None, False, None, "f", None), ("r", "jpql", "q", False, "contested entity", "g", 3), ("r", "x", "q", False, None, None, 4)], "repo string, query_kind string, query string, available boolean, reason string, file string, line int")
    got = {(r.scoring, r.stratum): (r.n, r.n_available) for r in ledger.lineage_strata(rows).collect()}
    assert got[("callable", "all")] == (3, 1) and got[("pooled", "all")] == (4, 1) and got[("callable", "null_query")] == (1, 0) and got[("pooled", "native")] == (2, 1)
    failed = ledger.failures(rows)
    assert _rows(failed, "locator") == [("lineage|jpql|contested_refuse|g|3|",), ("lineage|null_query|null_query|f||",), ("lineage|other|unavailable_unknown||4|",)]
    assert _rows(ledger.dominant(failed)) == [("r", "contested_refuse", 1)]


def test_runs(spark):
    stages = spark.createDataFrame([("a", "ok"), ("a", "failed"), ("b", "running"), ("c", "ok"), ("c", None)], "run string, status string")
    assert _rows(ledger.run_status(stages, "run")) == [("a", "failed", 2), ("b", "partial", 1), ("c", "complete", 2)]
    predicted = spark.createDataFrame([("stage2_architect_segment", 2), ("stage2_architect_merge", 1), ("stage4_doc_writer", 14), ("odd", 3)], "key string, n bigint")
    actual = spark.createDataFrame([("architect", 3), ("file_summarize", 5)], "stage string, n bigint")
    assert {r.stage: r.verdict for r in ledger.fanout(predicted, actual).collect()} == {"architect": "as predicted", "doc_writer": "not run", "file_summarize": "not predicted", "odd": "unmapped"}
    status = spark.createDataFrame([(1, " M src/a b.py\nR  old.md -> docs/new.md\n?? x.txt\nnoise",)], "doc_id int, text string")
    assert _rows(ledger.out_of_scope(ledger.changed_paths(status), ["docs"]), "state", "path") == [("??", "x.txt"), ("M", "src/a b.py")]


def test_first_failing_check_of_a_covering(spark):
    roots = spark.createDataFrame([(r, s, f"{s}!") for r in "abcdefg" for s in gates.SCOPES[:2]], "repo string, scope string, root string")
    proofs = spark.createDataFrame([(r, 2 if r == "b" else 1, "all_signatures!", "v2" if r == "c" else "v1", "no" if r in "bd" else "all_signatures!", "v1") for r in "abcdefg"], "repo string, schema_version int, inventory_root string, scanner_version string, barrier_root string, known_version string")
    ok = ("complete", "java_only", "java_only!", "java_only!")
    rows = [("a", 0, "s", *ok), ("b", 0, "s", *ok), ("c", 0, "s", *ok), ("d", 0, "s", *ok), ("f", 0, "s", *ok), ("f", 1, "t", "complete", "java_only", "java_only!", "other"), ("f", 2, "u", "failed", "java_only", "", ""), ("g", 0, "s", "complete", "half", "", "")]
    receipts = spark.createDataFrame(rows, "repo string, nth int, scanner string, status string, scope string, expected_root string, acked_root string")
    assert {r.repo: r.reason for r in gates.covering_verdict(proofs, receipts, roots).collect()} == {"a": None, "b": "version", "c": "scanner version", "d": "barrier root", "e": "no receipts", "f": "acknowledged root: t", "g": "unknown scope: s"}
    expected = spark.createDataFrame([("a", "s"), ("a", "x"), ("f", "u")], "repo string, scanner string")
    assert _rows(gates.barrier(expected, receipts)) == [("a", "x", "missing"), ("f", "u", "incomplete")]


def test_validators(spark):
    q = [(1, 0, "a", "t", "q", "x/F.java:3"), (1, 1, "b", "t", "q", "F.java"), (1, 2, "a", "t", "q", "x/.../F.java:3"), (1, 3, "a", "t", None, "F.java:1"), (2, 0, "z", "t", "q", " ")]
    got = gates.question_faults(spark.createDataFrame(q, "doc_id int, place int, blocks_file string, topic string, question string, evidence string"), ["a", "b"], 3)
    assert _rows(got) == [(1, 1, "no citation"), (1, 2, "comes back"), (1, 2, "elided path"), (1, 3, "missing keys: question"), (1, None, "too many"), (2, 0, "evidence is empty"), (2, 0, "unknown file")]
    schema = "doc_id int, place int, lens string, severity string, anchors array<struct<line:int,what:string>>, verdict string, tiers array<string>"
    f = [(1, 0, "l", "s", [(1, "w")], None, None), (1, 1, "m", None, [], "v", ["C", "C"]), (1, 2, "l", "s", [(None, "w")], "u", ["A", "D"])]
    assert _rows(gates.finding_faults(spark.createDataFrame(f, schema), ["l"], ["s"], ["v"])) == [(1, 1, "lens"), (1, 1, "no anchor"), (1, 1, "severity"), (1, 1, "tier C only"), (1, 2, "anchor without line or text"), (1, 2, "tier"), (1, 2, "verdict")]
    runs = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", True)], "mutant string, killed boolean")
    assert dict(_rows(gates.mutants(runs, spark.createDataFrame([("c",), ("d",), ("e",)], "mutant string")))) == {"a": "killed", "b": "new survivor", "c": "accepted", "d": "stale", "e": "stale"}
    manifests = spark.createDataFrame([(1, "complete", 2), (2, "running", 2), (3, "complete", None)], "artifact_id int, status string, n_signatures int")
    assert dict(_rows(gates.accepted(manifests), "artifact_id", "reason")) == {1: None, 2: "still running", 3: "no signatures"}


def test_layouts_keep_tokens(spark):
    from sedimark.functions.text import token_key

    text = 'package a;\n\nimport b.C;\n@X("/y")\nclass A {\n    @Get("/z")\n    int f() { return 1; }\n}\n'
    one = spark.createDataFrame([(text,)], "t string")
    for c in ledger.perturbed(F.col("t")).values():
        row = one.select(c.alias("c"), (token_key(c) == token_key(F.col("t"))).alias("same"), (c != F.col("t")).alias("moved")).head()
        assert row.same and row.moved


def test_citations_claims_and_symbols(spark):
    files = spark.createDataFrame([(1, "r", "a/x/F.java", "1\n2\n3\n"), (2, "r", "b/x/F.java", "1\n"), (3, "r", "Top.java", "1")], "file_id bigint, repo string, rel_path string, content string")
    tags = ["a/x/F.java:3", "x/F.java:3", "c/x/F.java", "b/x/F.java:2", "Top.java:1", "F.java:4"]
    docs = spark.createDataFrame([(1, "r", " ".join(f"[Evidenced — {t}]" for t in tags))], "doc_id bigint, source string, text string")
    assert [v for _, v in _rows(documents.resolved(docs, files), "nth", "verdict")] == ["resolved", "resolved", "missing", "past the end", "resolved", "past the end"]
    said = spark.createDataFrame([(1, "First. The gate calls `openGate()` late [Confirmed — interview, 1]. It was `@Late`, says GateKeeper. [Confirmed — interview, 2]\nx [Unknown]")], "doc_id bigint, text string")
    claims = documents.tagged_claims(said)
    assert _rows(claims, "nth", "claim") == [(0, "The gate calls `openGate()` late"), (1, "It was `@Late`, says GateKeeper.")]
    assert [r[0] for r in claims.orderBy("nth").select(documents.claim_symbols(F.col("claim"))).collect()] == [["openGate"], ["@Late", "GateKeeper"]]


def test_claims_about_files(spark):
    files = spark.createDataFrame([(1, "r", "a.py", "call(x)"), (2, "r", "b.py", None)], "file_id bigint, repo string, rel_path string, content string")
    rows = [(i, p, "r", f, n) for i, (p, f, n) in enumerate([("path_exists", "a.py", ""), ("path_absent", "z.py", ""), ("contains", "a.py", "x"), ("not_contains", "z.py", "x"), ("called_by", "a.py", "call"), ("called_by", "a.py", "x"), ("unchanged_since", "a.py", "00"), ("odd", "a.py", "")])]
    got = verify.claims_hold(spark.createDataFrame(rows, "claim_id int, predicate string, repo string, path string, needle string"), files)
    assert [ok for _, _, ok in _rows(got, "claim_id", "predicate", "ok")] == [True, True, True, False, True, False, False, None]


def test_reaching_and_order(spark):
    edges = spark.createDataFrame([("r", "A", "B"), ("r", "B", "C"), ("r", "C", "A"), ("r", "C", "Root"), ("r", "X", "Y"), ("s", "A", "B")], "repo string, src string, dst string")
    assert _rows(graph.reaching(edges, spark.createDataFrame([("Root",)], "name string"))) == [("r", "A"), ("r", "B"), ("r", "C")]
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", None]), i) for i in rng.sample(range(1000), 300)]
    want, n = {}, {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        want[g, i] = n[g] = n.get(g, -1) + 1
    assert {(r.g, r.i): r.seq for r in range_index(spark.createDataFrame(rows, "g string, i int").repartition(5), ["g"], ["i"]).collect()} == want
    files = spark.createDataFrame([(i, "r", p, "x") for i, p in enumerate(["a/b.md", "a/keep.md", "c/d.py"])], "file_id bigint, repo string, rel_path string, content string")
    assert _rows(inventory.walked(files, ["*.md", "!keep.md"]), "path") == [("a/keep.md",), ("c/d.py",)]
    assert is_small(files) and bounded(files).count() == 3


def test_settings_and_verbs(spark, java, tmp_path):
    (tmp_path / ".sedimark.json").write_text('{"maxTokens": 50, "gitignore": ["*.md", "!keep.md"]}')
    found = Settings.from_conf(spark, str(tmp_path))
    assert (found.max_tokens, found.overlap, found.gitignore) == (50, 0.1, ("*.md", "!keep.md"))
    engine = Engine(spark, found)
    facts = engine.facts(java)
    assert facts.where("predicate = 'persistence__repository'").count() == 1
    assert {r.gate for r in engine.gates(evidence_rows(spark), java).where("not passed").collect()} == {"contract"}
    assert engine.edges(java).count() == 0


def evidence_rows(spark):
    return spark.createDataFrame([(1, None, 0, None, None, None)], "evidence_id bigint, file string, line int, rule_id string, bucket string, scanner string")
