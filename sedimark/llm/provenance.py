"""Files that nobody wrote by hand for the repo: generated, minified, third-party copies, data kept as code.

Path rules cover build and vendor directories, lock files, minified suffixes and versioned names. The comments before a file's
first code, however many, and after its last, strings left out, run through one automaton of notice phrases: a notice that only
generators write suffices, vaguer ones must meet. Licence phrases with the name of another party mark copies. What carries no
notice is told by its shape: machine members, scripts of short names without blanks, bodies that are almost all literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.session import spread

KINDS = ("generated", "minified", "third_party", "data")

#: Notices that suffice alone.
NOTICES = (
    "code generated by", "code generated from", "auto-generated", "autogenerated", "auto generated", "automatically generated", "this file is generated", "this file was generated",
    "this class was generated", "this class is generated", "file generated by", "machine generated", "machine-generated", "generated file", "generated code", "any edit is overwritten",
    "edits will be lost", "edits are lost", "changes will be lost", "changes are lost", "will be overwritten", "is overwritten by", "regenerate instead", "regenerated from",
    "automatisch erzeugt", "automatisch generiert", "nicht von hand", "nicht manuell", "nicht bearbeiten", "généré automatiquement", "généré par", "ne pas modifier", "ne pas éditer",
    "est produit par", "generado automáticamente", "generado por", "no editar", "no modificar", "@generated signedsource", "was automatically produced", "do not edit by hand",
    "do not edit manually", "not to be edited", "do not edit this file", "do not modify this file",
)
#: Phrases of how a file came about, of which two must meet, or one and a phrase that names a tool or its input.
MADE = (
    "generated by", "generated from", "generated on", "generated with", "produced by", "emitted by", "compiled from", "created by the", "derived from", "written by", "do not edit",
    "do not modify", "do not change", "do not touch",
)
TOOLS = ("source:", "compiler", "generator", "tool build", "interface file", "end of output", "stub", ".idl", ".proto", ".xsd", ".wsdl")
#: Phrases of licences.
LICENCES = (
    "licensed under", "released under", "apache license", "mit license", "mit licence", "bsd license", "gnu general public", "lesser general public", "mozilla public license",
    "@license", "@licence", "permission is hereby granted", "spdx-license-identifier", "see license", "see licence", "under the terms of", "isc license",
)
#: Directories of copies and of build results, and file names of lock files.
VENDOR_DIRS = frozenset("vendor vendors third_party third-party thirdparty 3rdparty node_modules bower_components jspm_packages godeps".split())
BUILD_DIRS = frozenset("generated generated-sources generated-src generated_src generated-test-sources __generated__ autogen codegen-out".split())
#: Names that say so only in their place: below a source set or build directory; above another project's directory.
GEN_ABOVE = frozenset("src main test build target out".split())
EXTERNAL = frozenset("external externals".split())
LOCK_FILES = frozenset(
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml pnpm-lock.yml bun.lock bun.lockb composer.lock gemfile.lock cargo.lock poetry.lock pipfile.lock uv.lock pdm.lock "
    "go.sum gradle.lockfile buildscript-gradle.lockfile packages.lock.json podfile.lock mix.lock pubspec.lock flake.lock conda-lock.yml deno.lock".split()
)
CODE = frozenset("java py js ts jsx tsx mjs cjs kt scala go rs c h cc cpp cs php rb".split())
SCRIPT = frozenset("js mjs cjs css".split())

#: A script is minified if at most so small a share of it is blank and it has a line of so many characters, or if so many names, its
#: keywords aside, are of one or two letters and no line is indented. Shorter scripts than so many characters are not judged.
BLANK_SHARE, LONG_LINE, SHORT_NAMES, LEAST_SCRIPT = 0.12, 400, 0.6, 200
#: Code is data if so many characters of literals make up this share of it, separators included.
DATA_CHARS, DATA_SHARE = 1_000, 0.9

_MINIFIED = re.compile(r"[.-]min\.(?:js|mjs|css)$|\.bundle\.js$")
_VERSIONED = re.compile(r"^[a-z][\w.]*-\d+\.\d+\.\d+(?:[-.][\w.]+)?\.\w+$")
_GENERATED_NAME = re.compile(r"\.(?:pb|pb2|g|generated|gen)\.\w+$|_pb2(?:_grpc)?\.py$|\.designer\.cs$")
_SLASH = re.compile(r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))")
_HASHED = re.compile(r"\"\"\"(?P<d>[\s\S]*?)\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?P<c>#[^\n]*)")
_DASHED = re.compile(r"'(?:[^'\n]|'')*'|(?P<c>--[^\n]*|/\*[\s\S]*?(?:\*/|\Z))")
_ANGLED = re.compile(r"(?P<c><!--[\s\S]*?(?:-->|\Z))")
_LINE_HASH = re.compile(r"(?m)^[ \t]*(?P<c>[#!][^\n]*)")
_STYLE = {"py": _HASHED, "rb": _HASHED, "sql": _DASHED, "xml": _ANGLED, "html": _ANGLED, "md": _ANGLED, "yml": _LINE_HASH, "yaml": _LINE_HASH, "properties": _LINE_HASH, "toml": _LINE_HASH}
_LITERAL = re.compile(r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w$])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)[lLfFdD]?\b")
_ANNOTATED = re.compile(r"(?m)^\s*@(?:javax\.annotation\.(?:processing\.)?|jakarta\.annotation\.)?Generated\s*(?:\(|$)")
_MACHINE = (re.compile(r"\bbitField\d+_"), re.compile(r"_FIELD_NUMBER\s*="), re.compile(r"\bmemoized\w*(?:Size|Initialized)"), re.compile(r"\bextends\s+(?:[\w.]+\.)?Generated\w+"))
_HOLDER = re.compile(r"(?:copyright|\(c\)|©)\s*(?:\(c\)|©)?\s*(?:\d{4}(?:\s*[-,–]\s*\d{4})*,?\s*)?(?:by\s+)?([^\n*/]{2,80})", re.I)
_NAMED = re.compile(r"@licen[sc]e\s+([\w.-]+)|^\W*([\w.-]+)\s+v?\d+\.\d+\.\d+", re.I | re.M)
_FILLER = frozenset("the and its all rights reserved authors author team inc ltd llc gmbh corp corporation company foundation project contributors inside released under licence license mit see".split())


#: What may stand before a file's first code: package and import clauses, declarations of the file's kind.
_PREAMBLE = re.compile(r"(?m)^\s*(?:(?:package|import|using|from)\b|#include|#pragma|#!|---|<\?xml|<!DOCTYPE)[^\n]*|^[\s;]+|[\s;]+\Z", re.I)
_STRICT = re.compile(r"[\"']use strict[\"']\Z")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """One automaton of all phrases; values are the phrase's class and number."""
    made = ahocorasick.Automaton()
    for cls, phrases in (("notice", NOTICES), ("made", MADE), ("tool", TOOLS), ("licence", LICENCES)):
        for p in phrases:
            made.add_word(p, (cls, p))
    made.make_automaton()
    return made


def comments(text: str, ext: str) -> tuple[str, str]:
    """(comments before the first code and after the last, text without comments and strings) of source text in the style of an
    extension. Package and import clauses are no code here."""
    head: list[str] = []
    foot: list[str] = []
    bare: list[str] = []
    code, at = False, 0
    for m in _STYLE.get(ext, _SLASH).finditer(text):
        gap, at = text[at : m.start()], m.end()
        bare.append(gap)
        if gap.strip() and _PREAMBLE.sub("", gap):
            code, foot = True, []
        groups = m.groupdict()
        if groups.get("c") is not None:
            (foot if code else head).append(m["c"])
            bare.append("\n")
            continue
        if groups.get("d") is not None and not text[: m.start()].strip():
            head.append(m["d"])
        elif not _STRICT.match(m.group()):
            code, foot = True, []
        bare.append('""')
    rest = text[at:]
    if rest.strip():
        foot = []
    return "\n".join(head + foot), "".join([*bare, rest])


def noticed(said: str) -> tuple[bool, bool]:
    """(a generator's notice, a licence) in comments."""
    flat = " ".join(re.sub(r"[\s*#/]+", " ", said).casefold().split())
    found: dict[str, set[str]] = {"notice": set(), "made": set(), "tool": set(), "licence": set()}
    for _, (cls, phrase) in automaton().iter(flat):
        found[cls].add(phrase)
    return bool(found["notice"]) or len(found["made"]) >= 2 or bool(found["made"] and found["tool"]), bool(found["licence"])


def _foreign(said: str, path: str) -> bool:
    """Whether licence comments name a party that the path doesn't: the owner's name is part of the owner's namespace."""
    own = path.casefold()
    names = [m[1] for m in _HOLDER.finditer(said)] + [m[1] or m[2] for m in _NAMED.finditer(said)]
    words = [{w for w in re.findall(r"[a-z]{3,}", n.casefold()) if w not in _FILLER} for n in names]
    words = [w for w in words if w]
    source = re.search(r"/java/(.*)/", own)
    space = source[1].split("/")[:2] if source else []
    if space and space[0] in ("org", "com", "io", "net") and any(x in w for w in words for x in space[1:]):
        return True  # a library's own namespace
    return bool(words) and not any(x in own for w in words for x in w if not re.search(rf"/{x}[-\w.]*$", own))


def _roots(rel_path: str) -> tuple[list[str], str]:
    """(directories above the source packages, file name), in lower case."""
    parts = rel_path.replace("\\", "/").lower().split("/")
    dirs, name = parts[:-1], parts[-1]
    for i in range(len(dirs) - 2):
        if dirs[i] == "src" and dirs[i + 2] in ("java", "kotlin", "scala", "groovy", "python"):
            return dirs[: i + 3], name
    return dirs, name


def classify(rel_path: str | None, full_path: str | None, text: str | None) -> tuple[str, str] | None:
    """(kind, why) of a file that wasn't written by hand for the repo, or None."""
    path = rel_path or full_path or ""
    dirs, name = _roots(path)
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if name in LOCK_FILES:
        return "generated", "lock file"
    if any(d in VENDOR_DIRS or (d in EXTERNAL and "src" not in dirs and i + 1 < len(dirs)) for i, d in enumerate(dirs)):
        return "third_party", "vendor directory"
    if any(d in BUILD_DIRS or (d == "gen" and i and dirs[i - 1] in GEN_ABOVE) for i, d in enumerate(dirs)):
        return "generated", "build directory"
    if _MINIFIED.search(name):
        return "minified", "suffix"
    if _GENERATED_NAME.search(name):
        return "generated", "suffix"
    if not text or not text.strip():
        return ("third_party", "versioned name") if _VERSIONED.match(name) else None
    text = text.replace("\r\n", "\n")
    said, bare = comments(text, ext)
    generated, licensed = noticed(said)
    if generated:
        return "generated", "notice"
    if licensed and _foreign(said, path):
        return "third_party", "licence"
    if _VERSIONED.match(name):
        return "third_party", "versioned name"
    if ext in CODE:
        if _ANNOTATED.search(bare):
            return "generated", "annotation"
        if sum(bool(p.search(bare)) for p in _MACHINE) >= 2:
            return "generated", "machine members"
        if _is_data(text):
            return "data", "literals"
    if ext in SCRIPT and (why := _is_minified(text, bare)):
        return "minified", why
    return None


_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new null of return super switch this throw true "
    "false try typeof undefined var void while with yield async await".split()
)


def _is_minified(text: str, bare: str) -> str | None:
    """Why a script is minified, or None."""
    if sum(map(text.count, " \n\t")) > BLANK_SHARE * len(text):
        return None
    lines = text.split("\n")
    if max(map(len, lines)) >= LONG_LINE:
        return "long lines"
    names = [n for n in _NAME.findall(re.sub(r"\.\s*[\w$]+", "", bare)) if n not in _KEYWORDS]
    if len(text) >= LEAST_SCRIPT and names and sum(len(n) <= 2 for n in names) >= SHORT_NAMES * len(names) and not any(x.startswith(("  ", "\t")) for x in lines):
        return "short names"
    return None


def _is_data(text: str) -> bool:
    """Whether the text is almost all literals and separators."""
    size = len(re.sub(r"\s+", "", text))
    if size < DATA_CHARS:
        return False
    literal = sum(len(re.sub(r"\s+", "", m)) for m in _LITERAL.findall(text))
    marks = len(re.findall(r"[,+:;=()\[\]{}-]", _LITERAL.sub("", text)))
    return literal >= DATA_CHARS * 0.5 and literal + marks >= DATA_SHARE * size


def sorted_out(files: DataFrame) -> DataFrame:
    """(file_id, kind, why): every file that is generated, minified, a third-party copy or data kept as code.

    Null, empty and blank contents are judged by their path alone. A file delivered twice gives two rows. Null paths are judged
    by full_path, else by content. Texts are read whole; notices count before the first code and after the last.
    """
    rows = files.where("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), "rel_path", "full_path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *cols = (c.to_pylist() for c in batch.columns)
            got = [(i, *k) for i, *x in zip(ids, *cols) if (k := classify(*x))]
            a, b, c = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], ["file_id", "kind", "why"])

    return spread(rows).mapInArrow(run, "file_id bigint, kind string, why string")


def by_repo(files: DataFrame) -> DataFrame:
    """(repo, kind, n): the files of each repo by kind; 'by hand' for the rest."""
    ids = files.select(F.col("file_id").cast("long").alias("file_id"), "repo")
    return ids.join(sorted_out(files), "file_id", "left").groupBy("repo", F.coalesce("kind", F.lit("by hand")).alias("kind")).agg(F.count("*").alias("n"))
