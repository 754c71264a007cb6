"""Operators of the core: SQL twins on the smallest data, and laws and small fixtures where SQL can't say it."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sedimark.engine import Engine
from sedimark.functions import text as T
from sedimark.operators import diff, documents, entities, evidence, gates, graph, inventory, routes, snapshots
from sedimark.plans import registry
from sedimark.sources import readers
from sedimark.streaming import twin


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_twin(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({registry.SQL[name]})").fetchall()
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    norm = lambda rows: sorted((tuple(map(_plain, r)) for r in rows), key=repr)
    assert norm(got) == norm(want)


def _brute_groups(rows, most, overlap):
    """The grouping as one plain loop over (path, tokens)."""
    total = sum(t for _, t in rows)
    planned = max(1, -(-total // most))
    groups, cur, size, carried, i = [], [], 0, set(), 0
    while i < len(rows):
        path, tok = rows[i]
        if cur and (size + tok > most or (len(groups) != planned - 1 and size >= total / planned)):
            groups.append(cur)
            tail, got = [], 0
            for p, t in cur[::-1]:
                if got >= size * overlap:
                    break
                if p in carried:
                    continue
                if got + t >= most:
                    break
                tail, got = [(p, t), *tail], got + t
            if got == size and (got + tok > most or (len(groups) != planned - 1 and got >= total / planned)):
                tail, got = [], 0
            cur, size, carried = tail, got, {p for p, _ in tail}
            continue
        cur = [*cur, (path, tok)]
        size += tok
        i += 1
    return [*groups, cur] if cur else groups


@pytest.mark.parametrize("seed", range(4))
def test_groups_match_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"f{i:03d}", rng.choice([1, 5, 40, 90, 250, 99])) for i in range(rng.choice([1, 30, 120]))]
    df = spark.createDataFrame([("r", i, p, t) for i, (p, t) in enumerate(rows)], "repo string, pos int, path string, tokens bigint")
    got: dict = {}
    for r in graph.group_files(df, 100, 0.1).orderBy("group_id", "pos").collect():
        got.setdefault(r.group_id, []).append((r.path, r.tokens))
    want = _brute_groups(rows, 100, 0.1)
    assert list(got.values()) == want
    assert {p for g in want for p, _ in g} == {p for p, _ in rows}
    assert all(sum(t for _, t in g) <= 100 or g[0][1] > 100 for g in want)


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), (None, "a")], "src string, dst string")
    got = {(r.src, r.dst): r.depth for r in graph.closure(edges).collect()}
    want = {(s, t) for s in "abc" for t in "abcd"} | {("d", "d")}
    assert set(got) == want and got["a", "d"] == 3 and got["d", "d"] == 1


def test_closure_of_a_long_chain(spark):
    n = 66
    reach = graph.closure(spark.createDataFrame([(i, i + 1) for i in range(n)], "src bigint, dst bigint").coalesce(1))
    got = {(r.src, r.dst): r.depth for r in reach.collect()}
    assert got == {(i, j): j - i for i in range(n + 1) for j in range(i + 1, n + 1)}
    cand = spark.createDataFrame([(1, 0), (1, n)], "id bigint, type bigint")
    assert {tuple(r) for r in graph.most_specific(cand, reach).select("id", "type").collect()} == {(1, 0)}


def test_most_specific_keeps_unrelated_types(spark):
    reach = graph.closure(spark.createDataFrame([("Jpa", "Crud"), ("Crud", "Root"), ("Mongo", "Root")], "src string, dst string"))
    cand = spark.createDataFrame([(1, "Jpa"), (1, "Crud"), (1, "Root"), (1, "Mongo"), (2, "Root")], "id int, type string")
    assert {tuple(r) for r in graph.most_specific(cand, reach).select("id", "type").collect()} == {(1, "Jpa"), (1, "Mongo"), (2, "Root")}


def _java(i, path, text):
    return (i, "r", path, None, path.rsplit("/", 1)[-1], ".java", text, None, None)


F_SCHEMA = "file_id bigint, repo string, rel_path string, full_path string, name string, ext string, content string, committed_at timestamp_ntz, loaded_at timestamp_ntz"


def test_imports_resolve_by_shortening(spark):
    files = spark.createDataFrame(
        [
            _java(1, "src/a/Foo.java", "package com.a;\npublic class Foo {}"),
            _java(2, "src/a/Bar.java", "package com.a;\nclass Bar {}"),
            _java(3, "src/b/Use.java", "package com.b;\nimport com.a.Foo;\nimport static com.a.Foo.X;\nimport com.a.*;\nimport com.a.Gone;\nimport org.x.Y;\nclass Use {}"),
        ],
        F_SCHEMA,
    )
    java = graph.parsed(files)
    got = {(r.qualified, r.target, r.confidence) for r in graph.resolve(graph.imports(java), graph.declarations(java), graph.members(java)).collect()}
    a, b = "src/a/Foo.java", "src/a/Bar.java"
    assert got == {
        ("com.a.Foo", a, "exact"), ("com.a.Foo.X", a, "exact"), ("com.a.*", a, "package-fanout"), ("com.a.*", b, "package-fanout"),
        ("com.a.Gone", a, "package-fanout"), ("com.a.Gone", b, "package-fanout"), ("org.x.Y", None, "unresolved"),
    }


def test_entities_and_naming(spark):
    files = spark.createDataFrame(
        [
            _java(1, "x/Invoice.java", 'package a.b;\n@Entity\n@Table(name = "billing_invoice")\npublic class Invoice {}'),
            _java(2, "x/LegacyAudit.java", "package a.b;\n@Entity\npublic class LegacyAudit {}"),
            _java(3, "x/SLARule.java", "@Entity\nclass SLARule {}"),
            _java(4, "x/Scan.java", "@EntityScan\nclass Scan {}"),
            _java(5, "y/Invoice.java", "package a.c;\n@Entity\nclass Invoice {}"),
        ],
        F_SCHEMA,
    )
    got = {(r.class_name, r.table, r.table_name_source, r.fqcn) for r in entities.entities(files).collect()}
    assert got == {("Invoice", "billing_invoice", "explicit", "a.b.Invoice"), ("LegacyAudit", "legacy_audit", "inferred-default-naming", "a.b.LegacyAudit"), ("SLARule", "slarule", "inferred-default-naming", "SLARule"), ("Invoice", "invoice", "inferred-default-naming", "a.c.Invoice")}
    states = {r.class_name: r.status for r in entities.entity_map(entities.entities(files)).collect()}
    assert states == {"Invoice": "contested", "LegacyAudit": "single", "SLARule": "single"}


def test_jpql_refusals_and_lineage(spark):
    q = spark.createDataFrame(
        [(1, "r", "select i from LegacyAudit i where i.id = 1"), (2, "r", "select a from A a join B b on 1 = 1"), (3, "r", "select i from LegacyAudit i where i.owner.id = 1"), (4, "r", "select x from Nope x"), (5, "r", "select i from Invoice i"), (6, "r", "select size(i.x) from A i where SIZE(i.y) > 1"), (7, "r", "select a from A a, B b")],
        "id int, repo string, query string",
    )
    known = spark.createDataFrame([("r", "LegacyAudit", "legacy_audit", "single"), ("r", "Invoice", "i", "contested")], "repo string, class_name string, table string, status string")
    got = {r.id: (r.source_table, r.reason) for r in entities.jpql_lineage(q, known).collect()}
    scope = "multi-entity or unparseable FROM clause"
    assert got == {1: ("legacy_audit", None), 2: (None, scope), 3: (None, "association path"), 4: (None, "unknown entity"), 5: (None, "contested entity"), 6: (None, "relationship function"), 7: (None, scope)}


def test_sql_lineage_by_the_parser(spark):
    got = entities.sql_lineage(spark, ["select * from a join b on a.x = b.x where a.id = :id and t = ?1", "insert into t select * from s", "select :#{#x.y} from"])
    assert got[0] == {"available": True, "source_tables": ["a", "b"], "target_tables": []}
    assert got[1]["target_tables"] == ["t"] and got[1]["source_tables"] == ["s"] and got[2]["available"] is False


def test_yaml_keys_keep_open_ancestors(spark):
    text = 'spring:\n  datasource:\n    url: "x"\n    # note\n    list:\n      - a: 1\n  jpa: {a: b}\n"quoted":\n  k: v\nflat.key: 1\nempty:\n'
    rows = spark.createDataFrame([(1, "r", "a.yml", None, "a.yml", ".yml", text, None, None)], F_SCHEMA)
    assert {r.key for r in evidence.yaml_keys(rows).collect()} == {"spring.datasource.url", "spring.jpa", "quoted.k", "flat.key"}


def test_gitignore_patterns(spark):
    rows = spark.createDataFrame([_java(i, p, "x") for i, p in enumerate(["a/b.log", "docs/x/y.md", "lib/z.java", "src/lib/z.java", "k/build/o.java", ".git/c"])], F_SCHEMA)
    keep = lambda *p: {r.path for r in inventory.walked(rows, list(p)).select("path").collect()}
    assert keep() == {"a/b.log", "docs/x/y.md", "lib/z.java", "src/lib/z.java"}
    assert keep("*.log", "/lib/", "docs/**/y.md") == {"src/lib/z.java"}


def test_symbols_round_trip(spark):
    rows = spark.createDataFrame([("a.b", "Type"), (None, "Ünder_1"), ("a", "1bad")], "p string, n string").select(T.type_symbol(F.col("p"), F.col("n")).alias("s"))
    rows = rows.select("s", T.parse_symbol(F.col("s")).alias("x"))
    got = [(r.s, r.x and (r.x.kind, r.x.namespaces, r.x.type_names)) for r in rows.collect()]
    assert got[0] == ("code spring . a/b/Type#", ("type", ["a", "b"], ["Type"])) and got[2] == (None, None)


def test_routes_meet_in_capitals(spark):
    ev = spark.createDataFrame([("r", '@GetMapping(path = "/a/{id:\\\\d+}/")'), ("r", '@RequestMapping("/all")')], "repo string, match string")
    spec = spark.createDataFrame([("r", "get", "/a/{id}"), ("r", "post", "/b")], "repo string, verb string, path string")
    got = {(r.verb, r.path): r.verdict for r in routes.join_routes(routes.code_routes(ev), spec).collect()}
    assert got["GET", "/a/{id}"] == "matched" and got["POST", "/b"] == "spec-only" and got["TRACE", "/all"] == "code-only" and len(got) == 10


def test_claims_outside_fences(spark):
    text = "# Title\n- See Foo.java here. Plain words.\n```java\nBar.java\n```\n| a | b |\n|---|---|\nsave() writes. [Evidenced — a/B.java:3]\n> quote OwnerType\nOwnerController uses spring.datasource.url now [evidenced — x]."
    rows = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [(r.line, r.sentence, r.artifacts) for r in documents.untagged_claims(rows).orderBy("line").collect()]
    assert got == [(2, "See Foo.java here.", ["Foo.java"]), (8, "save() writes.", ["save()"])]
    counts = documents.tag_counts(rows).first()
    assert (counts.evidenced, counts.malformed, counts.miscased) == (1, 0, 1)


def test_closest_matches_brute_force(spark):
    rng = random.Random(2)
    words = "ship dock crate port crane rope deck sail mast hull".split()
    a = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(40)]
    b = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(30)]
    want = {}
    for i, x in a:
        best = max((len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())), -j) for j, y in b)
        if best[0] >= 0.5:
            want[i] = (-best[1], round(best[0], 9))
    df = lambda rows: spark.createDataFrame(rows, "id int, text string")
    got = {r.left_id: (r.right_id, round(r.overlap, 9)) for r in documents.closest(df(a), df(b), 0.5).collect()}
    assert got == want


def test_roots_and_verdicts(spark):
    sig = spark.createDataFrame([("r", "b", "2"), ("r", "a", None), ("q", "z", "9")], "repo string, path string, sha256 string")
    import hashlib

    want = hashlib.sha256(b"a\0\nb\0" + b"2\n").hexdigest()
    assert {r.repo: r.root for r in diff.inventory_root(sig.repartition(3)).collect()}["r"] == want
    one, two = diff.merkle_root(sig.repartition(1)), diff.merkle_root(sig.repartition(3))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_islands_expectations_and_sets(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "pos int, k string")
    assert [tuple(r) for r in gates.islands(rows, "k", "pos").collect()] == [("a", 2)]
    counts = spark.createDataFrame([("x", 3), ("y", 1)], "rule_id string, n bigint")
    want = spark.createDataFrame([("x", "asserted", 3), ("y", "minimums", 2), ("z", "minimums", 1)], "rule_id string, block string, want int")
    assert {r.rule_id for r in gates.expectations(counts, want).collect()} == {"y", "z"}
    names = spark.createDataFrame([("readme",), ("extra",)], "name string")
    assert {tuple(r) for r in gates.expected_set(names, ["readme", "testing"]).collect()} == {("testing", "missing"), ("extra", "extra")}


def test_row_order_and_partitions_do_not_matter(spark, data):
    df = spark.read.parquet(f"{data}/evidence.parquet")
    run = lambda x: sorted(map(str, evidence.first_seen(x, ["bucket", "file", "line", "rule_id"], ["src_ord", "row_ord"], ["evidence_id"]).collect()))
    assert run(df) == run(df.orderBy(F.rand(1)).repartition(9))
    double = evidence.rollup_counts(df.unionByName(df)).where("level = 2").first().n
    assert double == 2 * df.count()


def test_readers(spark, tmp_path):
    (tmp_path / "t/src").mkdir(parents=True)
    (tmp_path / "t/src/A.java").write_text("class A {}")
    (tmp_path / "t/src/b.bin").write_bytes(b"\xff\xfe\x00")
    rows = {r.rel_path: r for r in readers.source_tree(spark, str(tmp_path / "t"), "r").collect()}
    assert rows["src/A.java"].content == "class A {}" and rows["src/b.bin"].content is None and rows["src/A.java"].ext == ".java"
    (tmp_path / "c.csv").write_text("rule,n\nx,3\ny,oops\n")
    assert {tuple(r) for r in readers.counts_csv(spark, str(tmp_path / "c.csv")).collect()} == {("x", 3), ("y", None)}
    spec = spark.createDataFrame([("s", "paths:\n  /a/{id}:\n    get:\n      x: 1\n    post:\n  '/b':\n    delete:\n")], "name string, text string")
    assert {(r.verb, r.path) for r in readers.openapi_operations(spec).collect()} == {("GET", "/a/{id}"), ("POST", "/a/{id}"), ("DELETE", "/b")}
    facts = evidence.facts(spark.createDataFrame([("R", "f", "m", "b", 3, "s", 1)], "rule_id string, file string, match string, bucket string, line int, scanner string, evidence_id bigint"))
    readers.write_facts(facts, str(tmp_path / "facts"))
    assert spark.read.json(str(tmp_path / "facts")).first().subject == "f"
    engine = Engine(spark)
    files = engine.load(str(tmp_path / "t"), "r").withColumn("file_id", F.monotonically_increasing_id())
    assert engine.partition(files).count() >= 1
    with pytest.raises(ValueError):
        engine.scan(files, ["nope"])


def test_streams(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/evidence.parquet")
    (tmp_path / "in").mkdir()
    src.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = twin.rule_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == src.where("scanned_at is not null").count()
    sig = spark.read.parquet(f"{data}/file_signatures.parquet")
    for n in (1, 2):
        sig.where(f"snapshot_no = {n}").coalesce(1).write.parquet(str(tmp_path / f"snaps/{n}"))
    feed = spark.readStream.schema(sig.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "snaps"))
    q = twin.follow_snapshots(feed, str(tmp_path / "out"), ["repo"], ["path"], ["sha256"]).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.repo, r.path, r.change_kind) for r in spark.read.parquet(str(tmp_path / "out/changes")).where("batch = 1").collect()}
    want = snapshots.changes(sig.where("snapshot_no <= 2"), ["repo"], ["path"], ["sha256"])
    assert got == {(r.repo, r.path, r.change_kind) for r in want.collect()}
