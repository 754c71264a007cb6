"""Snapshot changes, schema drift and nested payloads against brute force on small fixtures."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sedimark.functions.ordered import carry_last, ordered_index
from sedimark.operators import nested, schema_drift, snapshots

DAY = datetime(2026, 1, 1)


def _snapshots(seed):
    rng, rows = random.Random(seed), []
    for repo in ("hot", "cold", None):
        state = {}
        for snap in range(1, 6):
            if repo == "cold" and snap == 3:
                continue  # not delivered
            for k in [None, *"abcdefgh"]:
                if rng.random() < 0.4:
                    state[k] = rng.choice([None, "x", "y", "z"])
                if rng.random() < 0.15:
                    state.pop(k, None)
            for k, v in state.items():
                if rng.random() < 0.3:
                    rows.append((snap, repo, k, rng.choice("pq"), DAY - timedelta(hours=1)))  # corrected later
                rows += [(snap, repo, k, v, DAY)] * rng.choice([1, 1, 2])
    return rows


def _expected(rows):
    last, delivered = {}, {}
    for snap, repo, k, v, at in rows:
        if (snap, repo, k) not in last or last[snap, repo, k][0] < at:
            last[snap, repo, k] = (at, v)
        delivered.setdefault(repo, set()).add(snap)
    out = set()
    for repo, snaps in delivered.items():
        order = sorted(snaps)
        for old, new in zip(order, order[1:]):
            a = {k: v for (s, r, k), (_, v) in last.items() if (s, r) == (old, repo)}
            b = {k: v for (s, r, k), (_, v) in last.items() if (s, r) == (new, repo)}
            out |= {(repo, k, new, "added") for k in b.keys() - a.keys()} | {(repo, k, new, "removed") for k in a.keys() - b.keys()}
            out |= {(repo, k, new, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


SCHEMA = "snapshot_no int, repo string, path string, sha256 string, loaded_at timestamp_ntz"


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_match_brute_force(spark, seed):
    rows = _snapshots(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in snapshots.changes(df.repartition(5), ["repo"], ["path"], ["sha256"]).collect()}
    assert got == _expected(rows)


def test_advance_swaps_the_index(spark):
    rows = _snapshots(3)
    df = spark.createDataFrame(rows, SCHEMA)
    index, got, scope, key = None, set(), ["repo"], ["path"]
    for snap in range(1, 6):
        step = snapshots.advance(index, df.where(F.col("snapshot_no") == snap), scope, key, ["sha256"])
        got |= {(r.repo, r.path, snap, r.change_kind) for r in snapshots.changed(step, scope, key).collect()}
        index = snapshots.entries(step)
    assert got == _expected(rows)
    assert {(r.repo, r.path) for r in index.collect()} == {(r, k) for s, r, k, _, _ in rows if s == 5}


def test_index_is_read_where_it_lies(spark):
    df = spark.createDataFrame(_snapshots(1), SCHEMA)
    first = snapshots.advance(None, df.where("snapshot_no = 1"), ["repo"], ["path"], ["sha256"])
    plan = snapshots.entries(first).join(snapshots.snapshot_index(df.where("snapshot_no = 2"), ["repo"], ["path"], ["sha256"]), snapshots.KEY, "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # only the delivery is shuffled


def test_ties_give_the_same_row_in_index_and_values(spark):
    rows = [(n, "r", k, v, DAY) for k in "abcdefgh" for n in (1, 2) for v in ("x", "y", "z")] + [(2, "r", "i", "x", DAY), (1, "r", "i", "y", DAY)]
    df = spark.createDataFrame(rows, SCHEMA)
    args = (["repo"], ["path"], ["sha256"])
    got = snapshots.with_values(snapshots.changes(df, *args), df, *args).collect()
    assert [(r.path, r.old.sha256, r.new.sha256) for r in got] == [("i", "y", "x")]


def _artifact(i, stream, minute, payload):
    text = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    return (i, stream, "certification.json", "r", DAY + timedelta(minutes=minute), DAY, text)


A_SCHEMA = "artifact_id bigint, stream_id string, artifact string, repo string, produced_at timestamp_ntz, loaded_at timestamp_ntz, payload string"


def test_drift_kinds(spark):
    gate = {"id": "G1", "label": "x", "required": True}
    rows = [
        _artifact(1, "s", 0, {"a": 1, "b": "x", "gates": [gate]}),
        _artifact(2, "s", 1, {"a": None, "b": "x", "gates": [{**gate, "extra": 1}]}),  # null keeps the type
        _artifact(3, "s", 2, None),
        _artifact(4, "s", 3, '{"a": 1, '),
        _artifact(5, "s", 4, {"a": "1", "bb": "x", "gates": {"id": "G1", "title": "x", "required": True}}),
        _artifact(6, "s", 5, {"a": "2", "bb": "x", "c": [], "gates": []}),  # an empty section says nothing
        _artifact(7, "s", 6, {"a": "2", "bb": "x", "c": {}, "gates": [{"id": "G1", "title": "y", "required": "no"}]}),
    ]
    got = {tuple(r) for r in schema_drift.drift(spark.createDataFrame(rows, A_SCHEMA)).select("artifact_id", "field_path", "change_kind").collect()}
    assert got == {
        (2, "gates[].extra", "added"), (5, "a", "retyped"), (5, "bb", "renamed"), (5, "gates[].title", "renamed"), (5, "gates[].extra", "removed"),
        (5, "gates", "retyped"), (6, "gates", "retyped"), (6, "c", "added"), (7, "c", "retyped"), (7, "gates[].required", "retyped"),
    }


def test_every_field_of_one_digest_finds_its_partner(spark):
    rows = [_artifact(1, "s", 0, {"flag_a": True, "flag_b": True, "flag_c": True, "k": 1}), _artifact(2, "s", 1, {"flagA": True, "flagB": True, "is_c": True, "k": 1})]
    got = {(r.field_path, r.old_path) for r in schema_drift.drift(spark.createDataFrame(rows, A_SCHEMA)).where("change_kind = 'renamed'").collect()}
    assert got == {("flagA", "flag_a"), ("flagB", "flag_b"), ("is_c", "flag_c")}


def _plain_drift(rows):
    """Changes of top-level fields by one plain loop."""
    out, state = set(), {}
    for i, stream, _, _, at, _, text in sorted(rows, key=lambda r: (r[4], r[0])):
        doc = json.loads(text)
        before, known = state.setdefault(stream, (None, {}))
        kind = lambda v: type(v).__name__
        if before is not None:
            added, removed = sorted(set(doc) - set(before)), sorted(set(before) - set(doc))
            for a in list(added):
                for r in removed:
                    if json.dumps(doc[a]) == json.dumps(before[r]):
                        out.add((i, a, "renamed"))
                        added.remove(a)
                        removed.remove(r)
                        break
            out |= {(i, a, "added") for a in added} | {(i, r, "removed") for r in removed}
            out |= {(i, k, "retyped") for k in doc if k in before and doc[k] is not None and k in known and known[k] != kind(doc[k])}
        known.update({k: kind(v) for k, v in doc.items() if v is not None})
        state[stream] = (doc, known)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_drift_over_many_ranges_matches_a_plain_loop(spark, seed):
    rng, rows, doc = random.Random(seed), [], {}
    for i in range(240):
        stream = "hot" if rng.random() < 0.8 else rng.choice(["a", None])
        doc = dict(doc)
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.choice("pqrstu")
            doc[k] = rng.choice([None, f"v{i}{k}", rng.randrange(10**6), {"x": rng.random()}])
        if doc and rng.random() < 0.3:
            k = rng.choice(sorted(doc))
            v = doc.pop(k)
            if rng.random() < 0.5 and v is not None:
                doc[f"n{i}"] = v
        rows.append(_artifact(i, stream, i // 2, doc))
    assert {tuple(r) for r in schema_drift.drift(spark.createDataFrame(rows, A_SCHEMA).repartition(5)).select("artifact_id", "field_path", "change_kind").collect()} == _plain_drift(rows)


def test_one_table_with_failed_casts(spark):
    rows = [
        _artifact(1, "s", 0, {"version": 3, "repo": "/r", "new": 1, "gates": [{"id": "a", "ok": True, "checks": []}], "tags": ["x"]}),
        _artifact(2, "s", 1, {"schemaVersion": 3, "repo": {"at": "/r"}, "new": "7", "gates": {"id": "b", "is_ok": True, "checks": [{"n": 1}, 5]}, "tags": "x"}),
        _artifact(3, "s", 2, {"schemaVersion": 3, "repo": "/q", "gates": [{"id": "c", "ok": "no"}, None], "tags": ["y", 4]}),
        _artifact(4, "t", 0, {"schemaVersion": "four", "repo": "/t", "gates": [{"id": "d", "is_ok": True}]}),
        _artifact(5, "t", 1, None), _artifact(6, "t", 2, "{"),
    ]
    table = schema_drift.consistent_table(spark.createDataFrame(rows, A_SCHEMA))
    got = {r.artifact_id: r.asDict(True) for r in table.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["version"] == got[2]["version"] == got[3]["version"] == 3  # renamed in stream s only
    assert got[4]["version"] is None and got[4]["schemaVersion"] == "four"
    assert got[2]["repo"] is None and json.loads(got[2]["others"]["repo"]) == {"at": "/r"} and got[2]["new"] == "7"
    assert got[2]["gates"] == [{"id": "b", "ok": True, "is_ok": None, "checks": [{"n": 1}, None]}] and got[1]["gates"][0]["checks"] == []
    assert got[3]["gates"] == [{"id": "c", "ok": None, "is_ok": None, "checks": None}, None] and got[4]["gates"][0]["is_ok"] is True
    assert got[3]["tags"] == ["y", "4"] and got[2]["tags"] is None
    assert [got[i]["failed_casts"] for i in (1, 2, 3, 4)] == [[], ["gates[].checks[]", "repo", "tags"], ["gates[].ok"], []]
    few = schema_drift.consistent_table(spark.createDataFrame(rows, A_SCHEMA), max_columns=2)
    assert {len(r.others) + sum(v is not None for c, v in r.asDict().items() if c not in ("artifact_id", "stream_id", "produced_at", "others", "failed_casts")) for r in few.where("artifact_id = 1").collect()} == {5}


def test_renames_chain_without_bound(spark):
    rows = [_artifact(i, "s", i, {f"name{i}": "v"}) for i in range(40)] + [_artifact(40 + i, "s", 40 + i, {"name39": "v" if i % 2 else "w"}) for i in range(4)]
    got = schema_drift.consistent_table(spark.createDataFrame(rows, A_SCHEMA)).collect()
    assert {r.name0 for r in got} == {"v", "w"} and all(r.others == {} for r in got)


def _walk(v, path, parent, out):
    if isinstance(v, list):
        for i, x in enumerate(v):
            q = f"{path}[{i}]"
            if isinstance(x, dict):
                out.add((q, parent))
                _walk(x, q, q, out)
            else:
                _walk(x, q, parent, out)
    elif isinstance(v, dict):
        for k, x in v.items():
            q = f"{path}.{k}" if path else k
            if isinstance(x, dict) and path in ("evidence", "entity_table_map"):
                q += "[0]" if path == "evidence" else ""
                out.add((q, parent))
                _walk(x, q, q, out)
            else:
                _walk(x, q, parent, out)


def test_nodes_match_a_recursive_walk(spark):
    docs = [
        {"evidence": {"a": [None, {"l": {"t": [{"x": 1}, [{"y": 2}]]}}], "b": {"m": 1, "s": [{}]}, "c": None}, "gates": {"checks": [{}]}},
        {"entity_table_map": {"p.Q": {"candidates": [{"columns": [{"n": 1}]}]}, "R": None}, "stages": [[[{"z": []}]]]},
        [{"top": [{}]}],
        "text",
    ]
    rows = [_artifact(i, "s", i, json.dumps(d)) for i, d in enumerate(docs)] + [_artifact(9, "s", 9, "{"), _artifact(10, "s", 9, None)]
    want = set()
    for i, d in enumerate(docs):
        out: set = set()
        _walk(d, "", "", out)
        want |= {(i, *x) for x in out}
    got = nested.nodes(spark.createDataFrame(rows, A_SCHEMA))
    assert {(r.artifact_id, r.node_path, r.parent_path) for r in got.collect()} == want
    assert {r.n_orphans for r in nested.table_counts(got).collect()} == {0}
    labels = {(r.artifact_id, r.label): r.node_path for r in got.collect()}
    assert all(labels.get((r.artifact_id, r.parent_label), "") == r.parent_path for r in got.collect())


def test_deep_nesting_is_walked_without_recursion(spark):
    deep = "[" * 300 + '{"a": 1}' + "]" * 300
    rows = spark.createDataFrame([_artifact(1, "s", 0, deep)], A_SCHEMA)
    assert [r.node_path for r in nested.nodes(rows).collect()] == ["[0]" * 300]


def test_ordered_functions_agree_with_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", None, "x"]), i, rng.choice([None, "u", "v"])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t int, v string").repartition(7)
    seq = ordered_index(df, ["g"], ["t"], F.floor(F.col("t") / 30))
    got = {(r.g, r.t): r.seq for r in seq.collect()}
    count, last, want, carried = {}, {}, {}, {}
    for g, t, v in rows:
        want[g, t] = count.get(g, 0)
        count[g] = want[g, t] + 1
        carried[g, t] = last.get(g)
        last[g] = v or last.get(g)
    assert got == want
    assert {(r.g, r.t): r.c for r in carry_last(seq, ["g"], "seq", "v", "c", bucket_rows=11).collect()} == carried
