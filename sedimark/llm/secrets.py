"""Credentials in source text: found by detection expressions on candidate texts, and hidden in place.

A trigram index names the candidate texts of each expression, and only those are matched, each as a whole: neither the length of
a text nor that of a value is bounded.
An expression proposes a value in a context that carries credentials (a telling name, a call, a URL, a known token format, a
key block); the value is then judged: references, placeholders, names, hashes, numbers and public material are no credentials.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.batches import parts
from sedimark.llm.trigrams import TrigramIndex, required
from sedimark.session import spread

#: Last words of names that carry credentials, in several languages, and pairs of last words.
TELLING = frozenset(
    "pass password passwd passphrase passcode pwd secret token auth authorization bearer cred creds credential credentials apikey kennwort passwort "
    "contrasena contraseña clave passe motdepasse pin seed sig signing session license licence salt hmac signature".split()
)
TELLING_PAIRS = frozenset({("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("account", "key"), ("auth", "key")})
#: First words of method names that read rather than set.
READING = frozenset("get has is find load read fetch resolve lookup require check verify validate".split())
#: Stems that occur in every telling name.
STEM = r"(?:pass(?:word|wd|phrase|code|wort|e)?|pwd|secret|token|auth(?:orization)?|bearer|cred(?:ential)?s?|api[-_.]?key|(?:access|private|secret|signing|encryption|account|auth)[-_.]?key|kennwort|contrasena|clave|pin|seed|sig|signing|signature|session|licen[sc]e|salt|hmac)"

#: Published formats of tokens.
_FORMATS = (
    r"\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{12,}"  # signed web tokens
    r"|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_\w{36}|\bgithub_pat_\w{50,}|\bglpat-[\w-]{20}|\bxox[abprs]-[\w-]{20,}"
    r"|\bAIza[\w-]{35}|\b[sr]k_live_\w{20,}|\bSG\.[\w-]{20,}\.[\w-]{40,}|\bnpm_\w{36}|\bhf_\w{30,}"
)
#: Formats nobody has published, by rule: a short prefix, a separator, maybe a second word, and a long body, which `random` judges.
_SHAPED = r"(?<![\w.+/=@-])[A-Za-z][A-Za-z0-9]{1,7}(?:[_-](?:[a-z]{2,8}[_-])?(?=[A-Za-z0-9]{20,})|\.(?=[\w-]{16,}\.[\w-]{24,}))(?P<v>[\w-]{16,}+(?:\.[\w-]{24,}+)?)(?![\w.+/=@-])"

#: name -> (expression, flags). Group v is the value, group s (where present) ends the name to judge.
EXPRESSIONS: dict[str, tuple[str, int]] = {
    "private_key": (
        r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:\\n|\\r|[\s\"'+,#|*/\\])*"
        r"(?:[A-Za-z][A-Za-z0-9-]*+:[ \t][^\n\\]*+(?:\\n|\\r|[\s\"'+,#|*/\\])+)*+[A-Za-z0-9+/=]{16,}+)", 0,
    ),
    "url": (r"[A-Za-z][\w+.-]{1,20}://[^\s:/@\"'<>]*+:(?P<v>[^\s@/\"'<>]{3,}+)@[\w\[]", 0),
    "format": (rf"(?P<v>{_FORMATS})", 0),
    "shaped": (_SHAPED, 0),
    "default": (rf"\$\{{[^{{}}\s:\"']*?(?P<s>{STEM}):(?P<v>[^{{}}\s\"']{{4,}}+)\}}", re.I),
    "scheme": (r"\bBasic (?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![\w+/=])", 0),
    "named": (
        rf"(?P<s>{STEM})(?:[\"']?\s*(?:\]\s*)?(?:=>|:=|[:=,])\s*[\"'](?P<v>[^\"'\n]{{4,}}+)[\"']|\(\s*[\"'](?P<call>[^\"'\n]{{4,}}+)[\"']\s*\))", re.I,
    ),
    "element": (rf"(?P<s>{STEM})>(?P<v>[^\S\n]*+(?:(?:Basic|Bearer|Token)[^\S\n]++)?[^<\s]{{4,}}+[^\S\n]*+)</", re.I),
    "line": (rf"^[ \t-]*+[\w.$-]*?(?P<s>{STEM})[ \t]*[:=](?![=>]?[ \t]*[\"'])[ \t]*(?P<line>[^\s\"']\S{{3,}}+(?: [A-Za-z0-9+/]{{8,}}={{0,2}})?)[ \t\r]*+(?=\n|\Z)", re.I | re.M),
    "property": (rf"name\s*=\s*[\"'][\w.-]*?(?P<s>{STEM})[\"']\s+value\s*=\s*[\"'](?P<v>[^\"'\n]{{4,}}+)[\"']", re.I),
    "pair": (rf"name:\s*[\"']?[\w.-]*?(?P<s>{STEM})[\"']?[^\S\n]*+\n\s*value:\s*[\"']?(?P<v>[^\"'\s]{{4,}}+)", re.I),
    "sql": (r"(?:\bpassword|\bidentified\s+by)\s+'(?P<v>[^'\n]{4,}+)'", re.I),
    "login": (r"basic[-_]?auth\w*\(\s*[\"'][^\"'\n]*[\"']\s*,\s*[\"'](?P<v>[^\"'\n]{4,}+)[\"']", re.I),
    "header": (r"header\(\s*[\"'](?P<h>[^\"'\n]+)[\"']\s*,\s*[\"'](?P<v>[^\"'\n]{6,}+)[\"']", re.I),
    "remark": (r"\b(?:login|password|passwd|pwd|credentials?)[ \t]+(?:was|is|are|were)[ \t]+(?:[\w.@-]+[ \t]*[/:][ \t]*)?(?P<v>\S{6,}+)", re.I),
    "note": (rf"[\"'][\w.-]*?(?P<s>{STEM}) (?P<v>[^\s\"']{{6,}}+)[\"']", re.I),
}
_COMPILED = {name: re.compile(p, f) for name, (p, f) in EXPRESSIONS.items()}
NAMES = list(EXPRESSIONS)
INDEX: list[TrigramIndex] = []

#: Extensions whose lines are name and value without quotes.
PLAIN = frozenset("properties yml yaml env ini conf cfg toml md txt sql".split())

_WORDS = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-Z]?[a-zà-ÿ]+|\d+")
_REFERENCE = re.compile(r"\$\{|\{\{|#\{|\$\(|^\$(?:[A-Z_]{3,}|[a-z_]{3,})$|^%\w+%$|^%\(|^<.*>$|^&lt;|^&#60;|^\[.*\]$|^!(?:vault|secret|ref|sub|include|env)\b|^(?:vault|env|secret|ssm|arn|keyring|file|classpath)[:/.]|\(\)")
_PLACEHOLDER = re.compile(r"^(.)\1*\Z|\.{3}|^(?:[x*#?-]{3,})$|change[-_ ]?(?:me|it)\b|(?:^|\W)(?:your|my|some)[-_ ]|example|dummy|placeholder|redacted|^(?:none|null|nil|todo|tbd|true|false|default|undefined|unset|empty|string|secret|password|hidden|masked)$", re.I)
_HASH = re.compile(r"^(?:sha\d+|md5|blake\w*)[-:=]|^\$(?:2[aby]?|argon2\w*|5|6|1)\$|^\{(?:bcrypt|noop|pbkdf2|sha)|^data:|^[\w+.-]+://|^(?:ssh-\w+|ecdsa-\S+) |^-----", re.I)
_PLAIN_NUMBER = re.compile(r"^[-+]?\d[\d.,:_/-]*[a-z%]{0,3}$|^P(?:\d+[YMWD])*(?:T(?:\d+[HMS])+)?$", re.I)
_IDENTIFIER = re.compile(r"^[A-Za-z_][\w.-]*$")
_NAMING = frozenset("header field name id url uri ttl policy length key path file type store label".split())
_COMMON_HEADERS = frozenset("accept content-type content-length user-agent host origin referer cache-control accept-language accept-encoding etag if-match if-none-match location".split())


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name)]


def telling(name: str) -> bool:
    """Whether a name ends in a word for a credential: db.password and X-ApiKey do, token-url and password_field don't."""
    words = _words(name)
    return bool(words) and (words[-1] in TELLING or tuple(words[-2:]) in TELLING_PAIRS or tuple(words[-3:]) == ("mot", "de", "passe")) and words[0] not in READING


def random(value: str) -> bool:
    """Whether letters of both cases and digits alternate in a value as they do in nothing that was made to be read: a change of kind
    at least every third character, and no character much more often than others."""
    core = [("d" if c.isdigit() else "u" if c.isupper() else "l", c) for c in value if c.isalnum()]
    if len({k for k, _ in core}) < 3:
        return False
    changes = sum(a != b for (a, _), (b, _) in zip(core, core[1:]))
    return 3 * changes >= len(core) and 3 * len({c for _, c in core}) >= min(len(core), 48)


def plausible(value: str) -> bool:
    """Whether a value in a credential's place can be one."""
    v = value.strip()
    v = re.sub(r"^(?:Basic|Bearer|Token)\s+", "", v, flags=re.I)
    if len(v) < 6 or any(ch.isspace() for ch in v) or _REFERENCE.search(v) or _PLACEHOLDER.search(v) or _HASH.search(v) or _PLAIN_NUMBER.search(v):
        return False
    kinds = any(c.islower() for c in v) + any(c.isupper() for c in v) + any(c.isdigit() for c in v) + any(not c.isalnum() for c in v)
    if kinds < 2 and len(v) < 16:
        return False
    if _IDENTIFIER.match(v) and len(v) < 40 and not random(v) and (words := _words(v)) and (telling(v) or words[-1] in _NAMING):
        return False
    return True


def _value(m: re.Match[str]) -> str:
    """The group that holds the value."""
    return next(g for g in ("v", "call", "line") if g in m.re.groupindex and m[g] is not None)


def _judged(rule: str, text: str, m: re.Match[str], group: str, plain: bool) -> bool:
    v = m[group]
    if rule in ("private_key", "format"):
        return True
    if rule == "shaped":
        return random(v) and not _HASH.search(m.group())
    if rule == "url":
        return not (_REFERENCE.search(v) or _PLACEHOLDER.search(v) or v.isdigit())
    if rule == "header":
        return m["h"].lower() not in _COMMON_HEADERS and plausible(v) and not re.match(r"^[a-z]{2,12}/[a-z0-9.+*-]+(?:;.*)?$", v)
    if rule == "remark":
        v = v.rstrip(".,;:)!?\"'")
        return plausible(v) and (any(c.isdigit() for c in v) or any(c.isupper() for c in v[1:]))
    if "s" in m.re.groupindex:
        a = m.start("s")
        while a and (text[a - 1].isalnum() or text[a - 1] in "_.$-"):
            a -= 1
        if group == "line" and text[text.rfind("\n", 0, a) + 1 : a].strip(" \t-"):
            return False
        if not telling(text[a : m.end("s")]):
            return False
    return plausible(v)


def _index() -> TrigramIndex:
    if not INDEX:
        INDEX.append(TrigramIndex([required(p, f) for p, f in EXPRESSIONS.values()]))
    return INDEX[0]


def spans(text: str, rules: list[str], plain: bool) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the credentials that the given expressions find. The inside of a rejected value is searched as well."""
    out = []
    for rule in rules:
        if rule == "line" and not plain:
            continue
        at = 0
        while m := _COMPILED[rule].search(text, at):
            group = _value(m)
            if _judged(rule, text, m, group, plain):
                end = m.start(group) + len(m[group].rstrip(".,;:)!?\"'")) if rule == "remark" else m.end(group)
                out.append((m.start(0) if rule in ("private_key", "shaped") else m.start(group), end, rule))
                at = m.end()
            else:
                at = m.end("s") if "s" in m.re.groupindex else m.start(group)
    return out


def find_in(texts: list[str | None], plain: list[bool]) -> list[list[tuple[int, int, str]]]:
    """The credentials of each text, by start; candidates come from the trigram index of the texts."""
    hit = _index().candidates([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i in hit.any(axis=0).nonzero()[0]:
        if texts[i]:
            out[i] = sorted(set(spans(texts[i], [NAMES[e] for e in hit[:, i].nonzero()[0]], plain[i])))
    return out


_KEY_END = re.compile(r"-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")


def _merged(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, bool]]:
    """(start, end, block) of what is to be hidden: overlapping credentials as their union. A key block reaches to its END mark and
    stays a block unless another credential sticks out of it."""
    out: list[tuple[int, int, bool]] = []
    for a, b, rule in sorted(found):
        block = rule == "private_key"
        if block and (end := _KEY_END.search(text, b)):
            b = end.start()
        if out and a < out[-1][1]:
            x, y, was = out[-1]
            out[-1] = (x, max(y, b), was and b <= y or block and a == x and b >= y)
        else:
            out.append((a, b, block))
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every credential hidden: values by REDACTED, letters of a key block by X, so that quotes, line ends and
    everything around them stay as they are."""
    out, at = [], 0
    for a, b, block in _merged(text, found):
        if block:
            head = text.index("-----", a + 5) + 5
            out += [text[at:head], re.sub(r"(?<!\\)[A-Za-z0-9+/=]{16,}", lambda m: "X" * len(m.group()), text[head:b])]
        else:
            out += [text[at:a], "REDACTED"]
        at = b
    return "".join([*out, text[at:]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tbl, row_id, text, plain = (c.to_pylist() for c in batch.columns)
        t, r, n = [], [], []
        every = (x for a, b in parts(text) for x in find_in(text[a:b], plain[a:b]))
        for i, found in enumerate(every):
            lines = {text[i].count("\n", 0, a) + 1 for a, _, _ in found}
            for line in sorted(lines):
                t.append(tbl[i])
                r.append(row_id[i])
                n.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(r, pa.int64()), pa.array(n, pa.int32())], ["tbl", "row_id", "line_no"])


def texts(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """(tbl, row_id, text, plain): the texts of both tables; plain texts hold names and values without quotes."""
    ext = F.lower(F.regexp_extract(F.coalesce("rel_path", F.lit("")), r"\.([^./\\]+)$", 1))
    f = files.select(F.lit("files").alias("tbl"), F.col("file_id").cast("long").alias("row_id"), F.col("content").alias("text"), ext.isin(*sorted(PLAIN)).alias("plain"))
    e = evidence.select(F.lit("evidence").alias("tbl"), F.col("evidence_id").cast("long").alias("row_id"), F.col("match").alias("text"), F.lit(True).alias("plain"))
    return f.unionByName(e).where("row_id is not null and text is not null and text <> ''")


def find(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """(tbl, row_id, line_no): lines with an embedded credential, counted from 1 at each LF.

    Whole texts are searched, whatever their length; null and empty ones have none. A file delivered twice counts twice. A
    multi-line key counts at its BEGIN mark, a value on a line after its name at the value.
    """
    return spread(texts(files, evidence)).mapInArrow(_rows, "tbl string, row_id bigint, line_no int")


def redacted(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """(tbl, row_id, text, n_hidden): the texts that hold credentials, with every one hidden."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            text, plain = rows["text"].tolist(), rows["plain"].tolist()
            found = [x for a, b in parts(text) for x in find_in(text[a:b], plain[a:b])]
            keep = [i for i, x in enumerate(found) if x]
            out = pd.DataFrame({"tbl": rows["tbl"].iloc[keep], "row_id": rows["row_id"].iloc[keep], "text": [redact(rows["text"].iloc[i], found[i]) for i in keep], "n_hidden": [len(_merged(rows["text"].iloc[i], found[i])) for i in keep]})
            schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("text", pa.string()), ("n_hidden", pa.int32())])
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    return spread(texts(files, evidence)).mapInArrow(run, "tbl string, row_id bigint, text string, n_hidden int")


def coverage(found: DataFrame, zones: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, n_found, n_zoned, n_missed, n_needless): lines found in files against the zones of an earlier scan.

    Zones name files by path in either system's style; null files or lines match nothing.
    """
    path = lambda c: F.regexp_replace(F.col(c), r"\\", "/")
    lines = found.where("tbl = 'files'").join(files.select(F.col("file_id").alias("row_id"), "repo", path("rel_path").alias("file")), "row_id").select("repo", "file", F.col("line_no").alias("line")).distinct().withColumn("f", F.lit(1))
    known = zones.select("repo", path("file").alias("file"), "line").where("file is not null and line is not null").distinct().withColumn("z", F.lit(1))
    both = lines.join(known, ["repo", "file", "line"], "full_outer")
    return both.groupBy("repo").agg(
        F.count("f").alias("n_found"), F.count("z").alias("n_zoned"), F.count(F.when(F.col("z").isNull(), 1)).alias("n_missed"), F.count(F.when(F.col("f").isNull(), 1)).alias("n_needless")
    )
