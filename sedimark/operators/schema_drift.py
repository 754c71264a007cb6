"""Drifting schemas of JSON files: what changed from file to file, and one table for all.

Every payload becomes path-value rows with raw types; their statistics by file and path (type, digest of the values) are compared
with those of the preceding readable file of the stream that says something about the path's parent. A file without any element of
a section says nothing about the fields of its elements.

The files of all streams lie in one order by stream, time and id, cut into ranges of even size, so a hot stream is many ranges.
A range is read once to learn the state in which it leaves its last stream (the fields of each section as last seen, the last known
types, the names that renamed fields began with). States of neighbouring ranges compose, and with the state in which a range is
entered its files are compared one after the other.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions import json_text
from sedimark.session import cut, spread, staged

#: Sections whose elements' fields count, in addition to the top level, and objects whose keys are data.
SECTIONS = ("gates", "stages", "evidence")
KEYED = ("evidence", "entity_table_map", "config_key_sets", "redaction_zones")
#: Most paths that become columns, the most frequent first; fields beyond stay in `others`.
MAX_COLUMNS = 2_000

_KINDS = ("boolean", "integer", "number", "string", "object", "array")
_CODE = {k: i for i, k in enumerate(_KINDS)} | {None: -1}


def _elements(section: str, value) -> list[dict]:
    """The objects of a section: elements of its array, or of all its buckets; one object stands for an array of one."""
    if section == "evidence" and isinstance(value, dict):
        return [e for bucket in value.values() for e in ([bucket] if isinstance(bucket, dict) else bucket if isinstance(bucket, list) else []) if isinstance(e, dict)]
    if isinstance(value, dict):
        return [value]
    return [e for e in value if isinstance(e, dict)] if isinstance(value, list) else []


def _statistics(payload: str | None) -> dict[str, dict[str, list]] | None:
    """section -> name -> [code of the type, digest of the values] of a readable payload; a section without elements is left out."""
    doc = json_text.read(payload)
    if not isinstance(doc, dict):
        return None
    out = {"": {name: [_CODE[json_text.kind(v)], json_text.digest([v])] for name, v in doc.items()}}
    for section in SECTIONS:
        seen: dict[str, list] = defaultdict(list)
        for e in _elements(section, doc.get(section)):
            for name, v in e.items():
                seen[name].append(v)
        if seen:
            out[section] = {}
            for name, values in seen.items():
                kinds = Counter(k for k in map(json_text.kind, values) if k)
                out[section][name] = [_CODE[kinds.most_common(1)[0][0]] if kinds else -1, json_text.digest(values)]
    return out


def path_statistics(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, stream_id, produced_at, stats): the path-type statistics of each readable file, packed.

    A payload is readable if it is a JSON object. An empty one has no field. A field whose elements have several types has
    the most frequent one, of equals the first. Null values have no type.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(a, s, t, _packed(got)) for a, s, t, p in pdf.itertuples(index=False, name=None) if (got := _statistics(p)) is not None]
            yield pd.DataFrame(rows, columns=["artifact_id", "stream_id", "produced_at", "stats"])

    rows = artifacts.where("artifact_id is not null").select(F.col("artifact_id").cast("long").alias("artifact_id"), "stream_id", F.col("produced_at").cast("timestamp_ntz").cast("string").alias("produced_at"), "payload")
    return spread(rows).mapInPandas(run, "artifact_id bigint, stream_id string, produced_at string, stats binary")


def _packed(x) -> bytes:
    return zlib.compress(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def _unpacked(x: bytes):
    return json.loads(zlib.decompress(x).decode("utf-8", "surrogatepass"))


# -- one stream, file by file -------------------------------------------------------------------------------------------------


def _fresh() -> dict:
    """The state before a stream's first file: fields as last seen, last known types, first names of renamed fields; by section."""
    return {"fields": {}, "known": {}, "roots": {}}


def _composed(a: dict, b: dict) -> dict:
    """The state after the files of `a`, then those of `b`; b's roots are names at a's end."""
    known = {s: {**a["known"].get(s, {}), **b["known"].get(s, {})} for s in a["known"] | b["known"]}
    roots = {s: dict(a["roots"].get(s, {})) for s in a["roots"]}
    for s, names in b["roots"].items():
        before = a["roots"].get(s, {})
        roots.setdefault(s, {}).update({n: before.get(r, r) for n, r in names.items()})
    return {"fields": {**a["fields"], **b["fields"]}, "known": known, "roots": roots}


def _gap(a: str, b: str) -> float:
    """Edit distance of two names, letter case and signs aside, over the longer one's length."""
    x, y = (("".join(c for c in s if c.isalnum()).lower()) for s in (a, b))
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1] / max(len(a), len(b), 1)


def _renames(added: list[str], removed: list[str], now: dict, before: dict) -> list[tuple[str, str]]:
    """(new name, old name): fields with the same values, the most similar names first, each name once."""
    by_digest: dict[str, list[str]] = defaultdict(list)
    for old in removed:
        by_digest[before[old][1]].append(old)
    pairs = sorted((_gap(new, old), new, old) for new in added for old in by_digest.get(now[new][1], ()))
    out, taken = [], (set(), set())
    for _, new, old in pairs:
        if new not in taken[0] and old not in taken[1]:
            taken[0].add(new)
            taken[1].add(old)
            out.append((new, old))
    return out


def _path(section: str, name: str) -> str:
    return f"{section}[].{name}" if section else name


def _step(state: dict, stats: dict[str, dict[str, list]]) -> list[tuple]:
    """The changes of a stream's next file, (path, kind, old path, old type, new type); `state` moves on."""
    out: list[tuple] = []
    name_of = lambda c: _KINDS[c] if c >= 0 else None
    for section, now in stats.items():
        before, known = state["fields"].get(section), state["known"].setdefault(section, {})
        if before is not None:
            added, removed = [n for n in now if n not in before], [n for n in before if n not in now]
            renamed = _renames(added, removed, now, before) if added and removed else []
            roots = state["roots"].setdefault(section, {})
            news = {new: roots.get(old, old) for new, old in renamed}
            gone = {old for _, old in renamed}
            for new, old in renamed:
                out.append((_path(section, new), "renamed", _path(section, old), name_of(before[old][0]), name_of(now[new][0])))
            for n in added:
                if n not in news:
                    out.append((_path(section, n), "added", None, None, name_of(now[n][0])))
                    roots.pop(n, None)
            for n in removed:
                if n not in gone:
                    out.append((_path(section, n), "removed", None, name_of(before[n][0]), None))
            for n in now:
                if n in before and now[n][0] >= 0 and known.get(n, now[n][0]) != now[n][0]:
                    out.append((_path(section, n), "retyped", None, name_of(known[n]), name_of(now[n][0])))
            roots.update(news)
        for n, (code, _) in now.items():
            if code >= 0:
                known[n] = code
        state["fields"][section] = now
    return out


# -- all streams, range by range ----------------------------------------------------------------------------------------------


class _Ranges:
    """The files in order, cut into ranges, with the states in which each range is entered."""

    def __init__(self, artifacts: DataFrame) -> None:
        order = ["stream_id", "produced_at", "artifact_id"]
        stats = staged(path_statistics(artifacts))
        n = max(stats.sparkSession.sparkContext.defaultParallelism, stats.rdd.getNumPartitions())
        self.rows = cut(stats.repartitionByRange(n, *order).sortWithinPartitions(*order))
        self.entry: dict[int, tuple] = {}

    def enter(self) -> None:
        """Learns the entry states: two passes, each of which sends one state a range to the driver."""
        self._fill("fields")
        self._fill("roots")

    def _fill(self, what: str) -> None:
        entry = self.entry
        first = what == "fields"

        def leave(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, starts, stream, state = TaskContext.get().partitionId(), True, None, None
            for pdf in parts:
                for a, s, _, packed in pdf.itertuples(index=False, name=None):
                    if state is None or s != stream:
                        starts = state is None
                        inherited = _inherited(entry, place, s) if starts and not first else None
                        stream, state = s, inherited or _fresh()
                        if inherited:
                            state["roots"] = {}  # names relative to the entry
                    stats = _unpacked(packed)
                    if first:
                        state["fields"].update(stats)
                        for section, now in stats.items():
                            state["known"].setdefault(section, {}).update({n: c for n, (c, _) in now.items() if c >= 0})
                    else:
                        _step(state, stats)
            if state is not None:
                yield pd.DataFrame([(place, starts, stream, _packed(state))], columns=["place", "starts", "stream", "state"])

        left = {r.place: r for r in self.rows.mapInPandas(leave, "place int, starts boolean, stream string, state binary").collect()}
        now: tuple | None = None
        self.entry = {}
        for place in range(self.rows.rdd.getNumPartitions()):
            if now:
                self.entry[place] = now
            if r := left.get(place):
                state = _unpacked(bytes(r.state))
                if r.starts and now and now[0] == r.stream:
                    state = _composed(_unpacked(now[1]), state)
                now = (r.stream, _packed(state))

    def walk(self, row, schema: str) -> DataFrame:
        """Rows of `row(artifact_id, stream, produced_at, changes, state)` for every file in order."""
        shared = self.rows.sparkSession.sparkContext.broadcast(self.entry)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, stream, state = TaskContext.get().partitionId(), None, None
            for pdf in parts:
                out: list[tuple] = []
                for a, s, t, packed in pdf.itertuples(index=False, name=None):
                    if state is None or s != stream:
                        stream, state = s, (_inherited(shared.value, place, s) if state is None else None) or _fresh()
                    out += row(a, s, t, _step(state, _unpacked(packed)), state)
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        return self.rows.mapInPandas(run, schema)


def _inherited(entry: dict[int, tuple], place: int, stream: str | None) -> dict | None:
    """The state in which a range is entered, if its first file is of the stream that the range before left open."""
    got = entry.get(place)
    return _unpacked(got[1]) if got and got[0] == stream else None


def drift(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, field_path, change_kind, old_path, old_type, new_type): changes against the stream's preceding readable file.

    Files follow each other by produced_at (null first), then artifact_id. A field that goes while one of the same parent comes
    with the same values is renamed; where several fit, the most similar names are paired first. A field that comes back is added. The
    type is compared with the last one known, nulls leave it as it was. The first file of a stream has no changes. Rows without a
    stream are a stream.
    """
    ranges = _Ranges(artifacts)
    ranges._fill("fields")
    changes = lambda a, s, t, found, state: [(a, *f) for f in found]
    return ranges.walk(changes, "artifact_id bigint, field_path string, change_kind string, old_path string, old_type string, new_type string")


# -- one table ----------------------------------------------------------------------------------------------------------------


def _kind(value) -> str | None:
    """The type of a value; an array that holds objects is rows, an empty one has none."""
    kind = json_text.kind(value)
    return kind if kind != "array" else "rows" if any(isinstance(x, dict) for x in value) else "array" if value else None


def _fields(path: str, obj: dict, roots: dict[str, dict[str, str]]) -> list[tuple[str, object]]:
    """(name, value) of an object's fields under the names that renamed ones began with. Of two fields for one name the one that has
    it counts, the other keeps its own."""
    names = roots.get("" if not path else path[:-2] if path.endswith("[]") else "-", {})
    took, out = set(obj), []
    for k, v in obj.items():
        to = names.get(k, k)
        if to in took and to != k:
            to = k
        took.add(to)
        out.append((to, v))
    return out


def _rows_of(path: str, value) -> list[tuple[str | None, object]] | None:
    """(key, element) of what is an array of objects: rows, objects whose keys are data, and one object where a section has an array."""
    if path in KEYED and isinstance(value, dict):
        return [(k, x) for k, v in value.items() for x in (v if isinstance(v, list) else [v])]
    if path in SECTIONS and isinstance(value, dict):
        return [(None, value)]
    return [(None, x) for x in value] if _kind(value) == "rows" or value == [] else None


def _types(doc: dict, roots: dict[str, dict[str, str]]) -> Counter:
    """(path, kind) -> 1 for each path of a payload and type that it has there; [] stands for the elements of an array."""
    out: set[tuple[str, str]] = set()
    todo: list[tuple[str, object]] = [("", doc)]
    while todo:
        path, value = todo.pop()
        rows = _rows_of(path, value)
        kind = "rows" if rows else _kind(value)
        if path and kind:
            out.add((path, kind))
        if rows is not None:
            todo += [(f"{path}[]", x) for _, x in rows]
        elif kind == "array":
            out |= {(f"{path}[]", json_text.kind(x)) for x in value if x is not None}
        elif isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in _fields(path, value, roots)]
    return Counter(out)


def _named_payloads(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, stream_id, produced_at, payload, roots): readable files, with the first names of their stream's renamed fields."""
    ranges = _Ranges(artifacts)
    ranges.enter()
    keep = lambda a, s, t, found, state: [(a, s, t, _packed({k: v for k, v in state["roots"].items() if v}))]
    named = ranges.walk(keep, "artifact_id bigint, stream_id string, produced_at string, roots binary")
    key = ["artifact_id", "stream_id", "produced_at"]
    payloads = artifacts.where("artifact_id is not null").select(F.col("artifact_id").cast("long").alias("artifact_id"), "stream_id", F.col("produced_at").cast("timestamp_ntz").cast("string").alias("produced_at"), "payload")
    once = named.groupBy(*key).agg(F.max("roots").alias("roots")).alias("n")
    return staged(once.join(payloads.alias("p"), [F.col(f"n.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key]).select("p.*", "n.roots"))


def path_types(named: DataFrame) -> DataFrame:
    """(path, kind, n): in how many files each path has each raw type."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in parts:
            for payload, roots in pdf.itertuples(index=False, name=None):
                if isinstance(doc := json_text.read(payload), dict):
                    total.update(_types(doc, _unpacked(bytes(roots))))
        yield pd.DataFrame([(p, k, n) for (p, k), n in total.items()], columns=["path", "kind", "n"])

    return named.select("payload", "roots").mapInPandas(run, "path string, kind string, n bigint").groupBy("path", "kind").agg(F.sum("n").alias("n"))


#: SQL types of columns by raw type; what has none of these is JSON text.
TYPES = {"boolean": "boolean", "integer": "bigint", "number": "double", "string": "string"}


class Column:
    """A typed place of the consistent table: a scalar, an array of scalars (of the type `of`), a struct, an array of structs, or JSON text."""

    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind, self.below, self.of = path, kind, {}, ""

    def add(self, name: str, made: Column) -> None:
        """Adds a field; of names that differ in letter case only, later ones get a number."""
        taken = {as_.lower() for as_, _ in self.below.values()} | ({"key"} if self.kind == "rows" and self.path in KEYED else set())
        self.below[name] = (name if name.lower() not in taken else f"{name}_{len(taken)}", made)

    def sql(self) -> str:
        if not self.below:
            return f"array<{TYPES[self.of]}>" if self.of else TYPES.get(self.kind, "string")
        inner = [f"`{as_.replace('`', '``')}`: {c.sql()}" for as_, c in self.below.values()]
        if self.kind == "rows":
            return f"array<struct<{', '.join(['key: string'] * (self.path in KEYED) + inner)}>>"
        return f"struct<{', '.join(inner)}>"

    def cast(self, value, roots: dict, failed: dict[str, list], others: dict[str, list]):
        """The value as this place's type; what doesn't fit is None and named in `failed`, fields that have no place in `others`."""
        if value is None:
            return None
        if self.below:
            rows = _rows_of(self.path, value)
            if self.kind == "rows" and rows is not None:
                keyed = self.path in KEYED
                return [self._struct(f"{self.path}[]", x, roots, failed, others, {"key": k} if keyed else {}) for k, x in rows]
            if self.kind == "object" and isinstance(value, dict):
                return self._struct(self.path, value, roots, failed, others, {})
            got = None
        elif self.of and isinstance(value, list):
            got = [_scalar(x, self.of) for x in value]
            failed_here = [x for x, g in zip(value, got) if g is None and x is not None]
            if failed_here:
                failed[f"{self.path}[]"] += failed_here
        else:
            got = None if self.of else _scalar(value, self.kind)
        if got is None:
            failed[self.path].append(value)
        return got

    def _struct(self, path: str, value, roots: dict, failed: dict, others: dict, out: dict):
        if not isinstance(value, dict):
            if value is not None:
                failed[path].append(value)
            return None
        out.update(dict.fromkeys(as_ for as_, _ in self.below.values()))
        for k, v in _fields(path, value, roots):
            if k in self.below:
                as_, below = self.below[k]
                out[as_] = below.cast(v, roots, failed, others)
            elif v is not None:
                others[f"{path}.{k}" if path else k].append(v)
        return out


def _scalar(value, kind: str):
    """A raw value as a scalar type, or None where it doesn't fit: whole numbers are numbers, and texts that read as the type are of it."""
    if kind == "boolean":
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(value.strip().lower()) if isinstance(value, str) else None
    if kind in ("integer", "number"):
        if isinstance(value, bool):
            return None
        try:
            got = int(value) if kind == "integer" and not isinstance(value, float) else float(value)
        except (TypeError, ValueError, OverflowError):
            return None
        return got if kind == "number" or isinstance(got, int) and -(2**63) <= got < 2**63 else None
    if kind == "string":
        return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else None
    return json_text.canonical(value) if isinstance(value, dict if kind == "object" else list) else None


def columns_of(types: DataFrame, max_columns: int = MAX_COLUMNS) -> Column:
    """The columns that the statistics ask for: each path has the type it has in most files, of equals the last of the alphabet.

    Objects become structs and arrays of objects arrays of structs; paths below anything else are left to the value above them.
    """
    ranked = types.groupBy("path").agg(F.sum("n").alias("n"), F.max(F.struct("n", "kind"))["kind"].alias("kind"))
    root = Column("", "object")
    made: dict[str, Column] = {"": root}
    for r in sorted(ranked.orderBy(F.desc("n"), "path").limit(max_columns).collect(), key=lambda r: (len(r.path), r.path)):
        if r.path.endswith("[]"):
            if (over := made.get(r.path[:-2])) and over.kind == "array" and r.kind in TYPES:
                over.of = r.kind
            continue
        # the place above: keys may hold dots, so the longest one that is known counts
        above = max((p for p in made if p == "" or r.path.startswith(f"{p}.") or r.path.startswith(f"{p}[].")), key=len)
        name = r.path[len(above) :].removeprefix("[]").removeprefix(".")
        if above == "" and "[]." in name:
            continue
        if made[above].kind in ("object", "rows") and (above == "" or r.path.startswith(f"{above}[].") == (made[above].kind == "rows")):
            made[r.path] = Column(r.path, r.kind)
            made[above].add(name, made[r.path])
    return root


def consistent_table(artifacts: DataFrame, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """One row for each readable file: artifact_id, stream_id, produced_at, a typed column for each top-level field, `others` and
    `failed_casts`.

    Columns follow from the statistics of types by path over all files (`columns_of`). Renamed fields stand under the name they began
    with in their stream. A value that doesn't fit is null in its column, its path in `failed_casts` and its text in
    `others`, which also holds fields without a column; values of several elements are a JSON array there. Columns named like one
    of the fixed ones get a number.
    """
    named = _named_payloads(artifacts)
    root = columns_of(path_types(named), max_columns)
    fixed = ["artifact_id", "stream_id", "produced_at", "others", "failed_casts"]
    names = {k: as_ if as_.lower() not in fixed else f"{as_}_1" for k, (as_, _) in root.below.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for a, s, t, payload, packed in pdf.itertuples(index=False, name=None):
                doc = json_text.read(payload)
                if not isinstance(doc, dict):
                    continue
                failed, others = defaultdict(list), defaultdict(list)
                got = root._struct("", doc, _unpacked(bytes(packed)), failed, others, {})
                texts = {p: json_text.canonical(v if "[]" in p else v[0]) for d in (others, failed) for p, v in d.items()}
                rows.append((a, s, t, *(got[as_] for as_, _ in root.below.values()), texts, sorted(failed)))
            yield pd.DataFrame(rows, columns=["artifact_id", "stream_id", "produced_at", *names.values(), "others", "failed_casts"], dtype=object)

    quoted = [f"`{names[k].replace('`', '``')}` {c.sql()}" for k, (_, c) in root.below.items()]
    schema = ", ".join(["artifact_id bigint", "stream_id string", "produced_at string", *quoted, "others map<string,string>", "failed_casts array<string>"])
    return named.mapInPandas(run, schema)
