"""Records that differ in formatting only: one row each, with its copies.

Each row is reduced to a 128-bit key that neither signs nor the order of attributes can change. Groups of a key are aggregated
map-side first, so a record with a third of all rows is one counter per task; the copies then meet the record's first row in a join
that adaptive execution splits where a key is hot, and every pair is compared exactly. Rows of a key that don't agree with its first
row are put together by their streams and canonical forms: rows that share either are one record, and so is what they link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm import folding
from sedimark.llm.batches import parts
from sedimark.session import cut, spread, staged

KEYS = ["repo", "line", "k1", "k2"]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        file, rule, match = (batch.column(i).to_pylist() for i in (3, 4, 5))
        done = [(folding.plain_hash(file[a:b]), folding.plain_hash(rule[a:b]), folding.bag_hash(match[a:b])) for a, b in parts(file, rule, match)]
        f, r, m = (np.concatenate(x) for x in zip(*done)) if done else [np.zeros(0, np.uint64)] * 3
        k1 = f ^ ((r << np.uint64(13)) | (r >> np.uint64(51)))
        cols = [*batch.columns, pa.array(k1.view(np.int64)), pa.array(m.view(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=["evidence_id", "repo", "line", "file", "rule_id", "match", "k1", "k2"])


def _digest(*texts: str | None) -> bytes:
    return hashlib.blake2b("\x04".join("\x05" if x is None else x for x in texts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _forms(file: str | None, rule: str | None, match: str | None) -> tuple[bytes, bytes]:
    """Digests of a row as a stream and with its attributes in order."""
    f, r = folding.folded(file), folding.folded(rule)
    return _digest(f, r, folding.folded(match)), _digest(f, r, folding.canonical(match))


_VERIFIED = pa.schema([("first_id", pa.int64()), ("copy_id", pa.int64()), ("same", pa.bool_()), ("p", pa.binary()), ("s", pa.binary()), ("fp", pa.binary()), ("fs", pa.binary())])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """first_id, copy_id, whether they are the same record by themselves and, unless they agree both as streams and with
    attributes in order, the digests of both forms of the copy (p, s) and of the first row (fp, fs)."""
    for batch in batches:
        first, copy, *texts = (c.to_pylist() for c in batch.columns)
        out: list[tuple] = []
        for f0, r0, m0, f1, r1, m1 in zip(*texts):
            near = folding.same_stream(f0, f1) and folding.same_stream(r0, r1)
            plain = near and folding.same_stream(m0, m1)
            ordered = near and (folding.same_record(m0, m1) if folding.structured(m0) or folding.structured(m1) else plain)
            out.append((True, None, None, None, None) if plain and ordered else (plain or ordered, *_forms(f1, r1, m1), *_forms(f0, r0, m0)))
        cols = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([first, copy, *cols], _VERIFIED)], schema=_VERIFIED)


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    """(first_id, p, s, own_id) of the forms of one key's rows (first_id, p, s, fp, fs, copy_id): the least id of the record that each is of."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    first_id, fp, fs = int(rows["first_id"].iloc[0]), rows["fp"].iloc[0], rows["fs"].iloc[0]
    for p, s in [(fp, fs), *zip(rows["p"], rows["s"])]:
        root[find(("p", p))] = find(("s", s))
    own = {find(("p", fp)): first_id}
    for p, i in zip(rows["p"], rows["copy_id"]):
        own[find(("p", p))] = min(own.get(find(("p", p)), int(i)), int(i))
    return pd.DataFrame({"first_id": first_id, "p": rows["p"], "s": rows["s"], "own_id": [own[find(("p", p))] for p in rows["p"]]})


def copies(evidence: DataFrame) -> DataFrame:
    """(first_id, copy_id): every row that repeats an earlier record, with the record's smallest evidence_id.

    Rows are the same record if repo and line are equal (null equals null) and file, rule_id and match agree apart from white
    space, letter case, signs and the order of named attributes in parentheses at any depth, or are linked by such rows. A null file, rule_id or match equals only null. Empty texts,
    and texts of signs only, equal each other and not null. Exact copies count as copies. Rows without evidence_id are left
    out. Extra columns are not read.
    """
    rows = evidence.where("evidence_id is not null").select(
        F.col("evidence_id").cast("long").alias("evidence_id"), "repo", F.col("line").cast("int").alias("line"), "file", "rule_id", "match"
    )
    hashed = staged(spread(rows).mapInArrow(_hashed, "evidence_id bigint, repo string, line int, file string, rule_id string, match string, k1 bigint, k2 bigint"))
    ids = hashed.groupBy(*KEYS).agg(F.min("evidence_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")  # no texts travel here
    on = [hashed[k].eqNullSafe(ids[k]) for k in KEYS]
    again = staged(hashed.join(ids, on).select("first_id", "evidence_id", "file", "rule_id", "match"))
    texts = lambda n: [F.col(c).alias(f"{a}{n}") for c, a in (("file", "f"), ("rule_id", "r"), ("match", "m"))]
    firsts = again.where("evidence_id = first_id").dropDuplicates(["first_id"]).select("first_id", *texts(0))
    others = again.where("evidence_id <> first_id").select("first_id", F.col("evidence_id").alias("copy_id"), *texts(1))
    pairs = others.join(firsts, "first_id").select("first_id", "copy_id", "f0", "r0", "m0", "f1", "r1", "m1")
    checked = cut(pairs.mapInArrow(_verified, "first_id bigint, copy_id bigint, same boolean, p binary, s binary, fp binary, fs binary"))
    apart = checked.where("not same")
    forms = checked.where("p is not null").groupBy("first_id", "p", "s", "fp", "fs").agg(F.min("copy_id").alias("copy_id"))
    linked = forms.join(apart.select("first_id").distinct(), "first_id", "left_semi").groupBy("first_id").applyInPandas(_linked, "first_id bigint, p binary, s binary, own_id bigint")
    moved = apart.select("first_id", "copy_id", "p", "s").join(linked, ["first_id", "p", "s"]).where("copy_id <> own_id").select(F.col("own_id").alias("first_id"), "copy_id")
    return checked.where("same").select("first_id", "copy_id").unionByName(moved)


def records(evidence: DataFrame) -> DataFrame:
    """(evidence_id, n_copies): one row for each record, with the number of its rows, the first included."""
    per = copies(evidence)
    counted = per.groupBy(F.col("first_id").alias("evidence_id")).agg((F.count("*") + 1).alias("n_copies"))
    ids = evidence.where("evidence_id is not null").select(F.col("evidence_id").cast("long").alias("evidence_id"))
    firsts = ids.join(per.select(F.col("copy_id").alias("evidence_id")), "evidence_id", "left_anti")
    return firsts.join(counted, "evidence_id", "left").select("evidence_id", F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
