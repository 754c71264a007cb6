"""Constraint queries and folds over pipeline artifacts: every check returns its violations, an empty result passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators import nested


def records(artifacts: DataFrame, section: str) -> DataFrame:
    """(artifact_id, place, name, status, required, detail) of the stage or gate records of certifications."""
    rows = nested.nodes(artifacts.where("artifact = 'certification.json'")).where(F.col("schema_path") == f"{section}[]")
    f = lambda *names: F.coalesce(*[F.col("fields")[n] for n in names])
    return rows.select("artifact_id", F.col("node_path").alias("place"), f("name", "id").alias("name"), f("status").alias("status"), f("required").try_cast("boolean").alias("required"), f("detail").alias("detail"))


def certification_fold(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, n_stages, n_gates, failures, certified): failing stages and required gates that didn't pass."""
    stages, gates = records(artifacts, "stages"), records(artifacts, "gates")
    bad = F.lower("status").isin("failed", "fail", "error", "missing")
    s = stages.select("artifact_id", F.lit(1).alias("s"), F.lit(0).alias("g"), F.when(bad, F.concat(F.lit("stage:"), "name")).alias("failure"))
    g = gates.select("artifact_id", F.lit(0).alias("s"), F.lit(1).alias("g"), F.when(bad & F.coalesce("required", F.lit(False)), F.concat(F.lit("gate:"), "name")).alias("failure"))
    per = s.unionByName(g).groupBy("artifact_id").agg(F.sum("s").alias("n_stages"), F.sum("g").alias("n_gates"), F.array_sort(F.collect_set("failure")).alias("failures"))
    return per.withColumn("certified", F.size("failures") == 0)


def evidence_violations(evidence: DataFrame) -> DataFrame:
    """(evidence_id, violation): rows that break the evidence contract, one for each breach."""
    checks = {
        "file missing": "file is null or trim(file) = ''",
        "line below one": "line < 1",
        "rule missing": "rule_id is null",
        "bucket missing": "bucket is null",
        "rule outside its bucket": "rule_id is not null and bucket is not null and split_part(rule_id, '__', 1) <> bucket",
        "scanner missing": "scanner is null",
    }
    found = F.filter(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return evidence.select("evidence_id", F.explode(found).alias("violation"))


def islands(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, islands): keys whose rows are not contiguous, by consecutive integer places; each row meets the one before it in an
    equi-join on the place, so no task sees more than its share."""
    before = rows.select(F.col(key).alias("_k"), (F.col(place) + 1).alias(place), F.lit(True).alias("_p"))
    met = rows.select(key, place).join(before, place, "left")
    starts = F.col("_p").isNull() | ~F.col(key).eqNullSafe(F.col("_k"))
    return met.where(starts).groupBy(key).agg(F.count("*").alias("islands")).where("islands > 1")


def expected_set(names: DataFrame, expected: list[str]) -> DataFrame:
    """(name, verdict): expected names that are missing and names that weren't expected."""
    want = names.sparkSession.createDataFrame([(n,) for n in expected], "name string")
    have = names.select("name").distinct()
    return want.join(have, "name", "left_anti").withColumn("verdict", F.lit("missing")).unionByName(have.join(want, "name", "left_anti").withColumn("verdict", F.lit("extra")))


def expectations(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """(rule_id, block, want, n): exact counts that differ and minimums that aren't reached; a missing count is 0.

    counts: (rule_id, n). expected: (rule_id, block, want) with block 'asserted' or 'minimums'.
    """
    met = expected.join(counts, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    broken = F.when(F.col("block") == "minimums", F.col("n") < F.col("want")).otherwise(F.col("n") != F.col("want"))
    return met.where(broken).select("rule_id", "block", "want", "n")


#: The version of covering proofs, and their checks in order; the first that fails is the verdict.
PROOF_VERSION = 1
CHECKS = ("version", "inventory root", "scanner version", "barrier root", "no receipts", "receipt failed", "receipt not complete", "no scope", "unknown scope", "expected root", "acknowledged root")
SCOPES = ("all_signatures", "java_only", "non_java")


def covering_verdict(proofs: DataFrame, receipts: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, ok, check_no, reason): proofs against the roots of their inventories; the first failing check by order counts.

    proofs: (repo, schema_version, inventory_root, scanner_version, barrier_root, known_version). receipts: (repo, nth, scanner, status,
    scope, expected_root, acked_root). roots: (repo, scope, root), the scope all_signatures for the inventory as a whole. Receipts are
    checked one after the other by nth, each by the checks in order. A scope without files has no root and differs.
    """
    whole = roots.where("scope = 'all_signatures'").select("repo", F.col("root").alias("whole"))
    head = proofs.join(whole, "repo", "left")
    no = lambda k: F.lit(CHECKS.index(k) + 1)
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    first = F.when(~F.col("schema_version").eqNullSafe(F.lit(PROOF_VERSION)), no("version")).when(differs("inventory_root", "whole"), no("inventory root"))
    first = first.when(differs("scanner_version", "known_version"), no("scanner version")).when(differs("barrier_root", "whole"), no("barrier root"))
    met = receipts.join(roots.select("repo", "scope", "root"), ["repo", "scope"], "left")
    each = F.when(F.col("status") == "failed", no("receipt failed")).when(~F.col("status").eqNullSafe(F.lit("complete")), no("receipt not complete"))
    each = each.when(F.coalesce("scope", F.lit("")) == "", no("no scope")).when(~F.col("scope").isin(*SCOPES), no("unknown scope"))
    each = each.when(differs("expected_root", "root"), no("expected root")).when(differs("acked_root", "root"), no("acknowledged root"))
    worst = met.withColumn("c", each).groupBy("repo").agg(F.count("*").alias("n"), F.min(F.when(F.col("c").isNotNull(), F.struct("nth", "c", "scanner"))).alias("w"))
    out = head.withColumn("first", first).join(worst, "repo", "left")
    check = F.coalesce("first", F.when(F.col("n").isNull(), no("no receipts")), "w.c")
    named = F.element_at(F.array(*map(F.lit, CHECKS)), check)
    reason = F.when(check > CHECKS.index("no receipts") + 1, F.concat_ws(": ", named, "w.scanner")).otherwise(named)
    return out.select("repo", check.isNull().alias("ok"), check.alias("check_no"), F.when(check.isNotNull(), reason).alias("reason"))


def barrier(expected: DataFrame, receipts: DataFrame) -> DataFrame:
    """(repo, scanner, fault): scanners of `expected` (repo, scanner) without a complete receipt (repo, scanner, status); an empty result lets the run go on."""
    done = receipts.groupBy("repo", "scanner").agg(F.max(F.when(F.col("status") == "complete", 1).otherwise(0)).alias("ok"))
    met = expected.distinct().join(done, ["repo", "scanner"], "left")
    return met.where("ok is null or ok = 0").select("repo", "scanner", F.when(F.col("ok").isNull(), "missing").otherwise("incomplete").alias("fault"))


def groups_complete(groups: DataFrame, declared: DataFrame) -> DataFrame:
    """(repo, declared, n): repos whose number of groups isn't the declared one (repo, num_groups)."""
    n = groups.groupBy("repo").agg(F.count_distinct("group_id").alias("n"))
    return declared.join(n, "repo", "left").select("repo", F.col("num_groups").alias("declared"), F.coalesce("n", F.lit(0)).alias("n")).where("declared is distinct from n")


def question_faults(questions: DataFrame, files: list[str], most: int = 40) -> DataFrame:
    """(doc_id, place, fault) of questions (doc_id, place, blocks_file, topic, question, evidence): missing keys, evidence without a
    citation or with an elided path, unknown files, files that come back after another one, and lists of more than `most`."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("blocks_file", "topic", "question", "evidence")]), lambda x: x.isNotNull())
    whole = F.size(missing) == 0
    before = questions.select("doc_id", (F.col("place") + 1).alias("place"), F.col("blocks_file").alias("_b"))
    rows = questions.join(before, ["doc_id", "place"], "left").withColumn("starts", ~F.col("blocks_file").eqNullSafe(F.col("_b")))
    first = questions.groupBy("doc_id", "blocks_file").agg(F.min("place").alias("_first"))
    rows = rows.join(first, ["doc_id", "blocks_file"], "left")
    faults = F.array(
        F.when(~whole, F.concat(F.lit("missing keys: "), F.array_join(missing, ","))), F.when(whole & (F.trim("evidence") == ""), "evidence is empty"), F.when(whole & F.col("evidence").contains("/.../"), "elided path"),
        F.when(whole & (F.trim("evidence") != "") & ~F.col("evidence").contains("/.../") & ~F.col("evidence").rlike(r"[\w./-]+\.\w+:\d+"), "no citation"),
        F.when(whole & ~F.col("blocks_file").isin(*files), "unknown file"), F.when(whole & F.col("starts") & (F.col("place") > F.col("_first")), "comes back"),
    )
    each = rows.select("doc_id", "place", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))
    long = questions.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("doc_id", F.lit(None).cast(questions.schema["place"].dataType).alias("place"), F.lit("too many").alias("fault"))
    return each.unionByName(long)


def finding_faults(findings: DataFrame, lenses: list[str], severities: list[str], verdicts: list[str], most: int = 60) -> DataFrame:
    """(doc_id, place, fault) of review findings (doc_id, place, lens, severity, anchors ARRAY<STRUCT<line, what>>, verdict, tiers
    ARRAY<STRING>): unknown lens, severity, verdict or tier, no anchor or one without line or text, sources of tier C alone, too many."""
    faults = F.array(
        F.when(~F.coalesce(F.col("lens").isin(*lenses), F.lit(False)), "lens"), F.when(~F.coalesce(F.col("severity").isin(*severities), F.lit(False)), "severity"),
        F.when(F.coalesce(F.size("anchors"), F.lit(0)) < 1, "no anchor"), F.when(F.exists("anchors", lambda a: a["line"].isNull() | a["what"].isNull()), "anchor without line or text"),
        F.when(F.col("verdict").isNotNull() & ~F.col("verdict").isin(*verdicts), "verdict"), F.when((F.size("tiers") > 0) & F.forall("tiers", lambda t: t == "C"), "tier C only"),
        F.when(F.exists("tiers", lambda t: ~t.isin("A", "B", "C")), "tier"),
    )
    each = findings.select("doc_id", "place", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))
    long = findings.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("doc_id", F.lit(None).cast(findings.schema["place"].dataType).alias("place"), F.lit("too many").alias("fault"))
    return each.unionByName(long)


def accepted(manifests: DataFrame) -> DataFrame:
    """(artifact_id, ok, reason) of manifests (artifact_id, status, n_signatures): running ones and those without signatures are refused."""
    reason = F.when(F.col("status").isNull(), "no status").when(F.col("status") == "running", "still running").when(F.coalesce("n_signatures", F.lit(0)) == 0, "no signatures")
    return manifests.select("artifact_id", reason.isNull().alias("ok"), reason.alias("reason"))


def staged_rows(stages: DataFrame, order: list[str], until: str | None = None) -> DataFrame:
    """The rows of `stages` (name, ...) whose stage is in a profile's order, up to and with `until`."""
    kept = order[: order.index(until) + 1] if until else order
    return stages.where(F.col("name").isin(*kept))


def rewritten(rows: DataFrame, external: DataFrame, executor: str = "mock") -> DataFrame:
    """Certification rows without those of an executor, with the rows of an external run in their place."""
    return rows.where(~F.col("executor").eqNullSafe(F.lit(executor))).unionByName(external, allowMissingColumns=True)


def gate_results(checks: dict[str, DataFrame]) -> DataFrame:
    """(gate, n_violations, passed): a sequence of constraint queries, each of which returns its violations."""
    counted = [df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("gate"), "n_violations") for name, df in checks.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out.withColumn("passed", F.col("n_violations") == 0)


def mutants(runs: DataFrame, accepted_: DataFrame) -> DataFrame:
    """(mutant, verdict): runs (mutant, killed) against a baseline of accepted survivors (mutant): killed, accepted, new survivor, or stale for a baseline row that was killed or is gone."""
    met = runs.groupBy("mutant").agg(F.max(F.col("killed").cast("int")).alias("k")).join(accepted_.select("mutant").distinct().withColumn("a", F.lit(1)), "mutant", "full_outer")
    verdict = F.when(F.col("a").isNotNull() & F.coalesce(F.col("k") == 1, F.lit(True)), "stale").when(F.col("k") == 1, "killed").when(F.col("a").isNotNull(), "accepted").otherwise("new survivor")
    return met.select("mutant", verdict.alias("verdict"))
