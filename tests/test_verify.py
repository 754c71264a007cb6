"""Verification operators on small fixtures."""

import random

from pyspark.sql import functions as F

from sedimark.operators import verify

F_SCHEMA = "file_id bigint, repo string, rel_path string, full_path string, name string, ext string, content string, committed_at timestamp_ntz, loaded_at timestamp_ntz"


def _files(spark, *rows):
    return spark.createDataFrame([(i, "r", p, None, None, None, t, None, None) for i, (p, t) in enumerate(rows, 1)], F_SCHEMA)


def test_contained_matches_brute_force(spark):
    rng = random.Random(1)
    names = lambda n: ["".join(rng.choices("abAB", k=rng.randint(1, 7))) for _ in range(n)] + ["", None, "ab"]
    a, b = names(60), names(50)
    low = lambda xs: {x.lower() for x in xs if x}
    want = {(x, y) for x in low(a) for y in low(b) if x == y or (len(x) > 2 and x in y) or (len(y) > 2 and y in x)}
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert {tuple(r) for r in verify.contained(df(a), df(b)).collect()} == want


def test_comments_become_blanks_of_the_same_length(spark):
    text = 'a /* x\ny */ b // z\nurl "http://h" c\n'
    got = spark.createDataFrame([(text,)], "t string").select(verify.blank_comments(F.col("t"))).first()[0]
    assert len(got) == len(text) and got.split() == ["a", "b", "url", '"http://h"', "c"] and got.count("\n") == text.count("\n")


def test_build_files(spark):
    pom = "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency><!-- <dependency><groupId>no</groupId></dependency> --></dependencies><build><plugin><artifactId>p</artifactId></plugin></build></project>"
    toml = '[versions]\nboot = "3.2"\n[libraries]\nx = { module = "g:n", version.ref = "boot" }\ny = { group = "g2", name = "n2" }\n'
    files = _files(spark, ("m/pom.xml", pom), ("gradle/libs.versions.toml", toml))
    assert {tuple(r)[1:] for r in verify.maven(files).collect()} == {("dependency", "g", "a", "1", "compile"), ("plugin", "org.apache.maven.plugins", "p", None, None)}
    assert {tuple(r)[1:] for r in verify.version_catalog(files).collect()} == {("version", "boot", "3.2"), ("library", "x", "g:n"), ("library", "y", "g2:n2")}


def test_python_metrics(spark):
    files = _files(spark, ("a.py", "def f(x: int, y):\n    if x and y:\n        return 1\n"), ("b.py", "def f(:"), ("c.py", ""))
    got = {r.file_id: tuple(r)[1:] for r in verify.python_metrics(files).collect()}
    assert got == {1: (1, 3, 3, 3, 0.5), 3: (0, 0, 0, 0, None)}


def test_supertypes_without_generics(spark):
    files = _files(spark, ("A.java", "package x;\npublic class A<T extends Q<R>> extends B<Map<C, D>> implements E, f.G<H> {\n}"), ("I.java", "interface I extends J, K {}"))
    assert {(r["sub"], r["super"]) for r in verify.supertypes(files).collect()} == {("A", "B"), ("A", "E"), ("A", "f.G"), ("I", "J"), ("I", "K")}


def test_anchors_and_claims(spark):
    files = _files(spark, ("a/B.java", "\n".join(["x"] * 20 + ["void loadCargo() {}"] + ["y"] * 20)))
    ev = spark.createDataFrame([(1, "r", "a\\B.java", 18, "loadCargo()"), (2, "r", "a/B.java", 2, "loadCargo()"), (3, "r", "a/B.java", 2, "nothingHere"), (4, "r", "gone.java", 1, "loadCargo"), (5, "r", "a/B.java", None, "x")], "evidence_id bigint, repo string, file string, line int, match string")
    assert {tuple(r) for r in verify.anchors(ev, files).collect()} == {(1, "near"), (2, "far"), (3, "absent")}
    claims = spark.createDataFrame([(1, "path_exists", "r", "a/B.java", None), (2, "path_absent", "r", "a/B.java", None), (3, "contains", "r", "a/B.java", "loadCargo"), (4, "not_contains", "r", "zz", "x"), (5, "other", "r", "zz", "x")], "claim_id int, predicate string, repo string, path string, needle string")
    assert {r.claim_id: r.ok for r in verify.claims_hold(claims, files).collect()} == {1: True, 2: False, 3: True, 4: False, 5: None}
