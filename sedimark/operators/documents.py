"""Documents: evidence tags, claims, citations against files, similarity to answers, diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.text import posix
from sedimark.operators.inventory import with_path
from sedimark.session import spread

#: The tag forms, and words that don't count for similarity.
TAGS = {
    "evidenced": r"\[Evidenced — [^\];]+(?:; inference avoided beyond this)?\]",
    "confirmed": r"\[Confirmed — interview, [^\]]+\]",
    "unknown": r"\[Unknown — not evidenced in code, not covered in interview\]",
    "per_existing_docs": r"\[Per existing docs — [^,]+, unverified against code\]",
}
ANY_TAG = r"(?i)\[(?:evidenced|confirmed|unknown|per existing docs)\b[^\]]*\]"
STRICT_TAG = r"\[(?:Evidenced|Confirmed|Unknown|Per existing docs)\b[^\]]*\]"
STOPWORDS = "the a an is are was were this that it its to of in on for and or not be by as with at if so than then will would".split()
#: What names a concrete artifact in a sentence.
ARTIFACTS = (
    r"\b[\w./-]+\.(?:java|kt|xml|ya?ml|properties|gradle|sql|json|tf|sh)\b", r"\bDockerfile\b", r"@[A-Z]\w+", r"\b[a-z]\w*\(\)",
    r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b", r"\b[a-z][a-z0-9_-]*(?:\.[a-z0-9_-]+){2,}\b", r"\b[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)+\b",
)


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def tag_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, evidenced, confirmed, unknown, per_existing_docs, malformed, miscased); null texts count 0.

    Malformed spans begin with a tag word and have none of the forms; miscased ones begin with one in other letters.
    """
    text = F.coalesce("text", F.lit(""))
    counts = {k: F.size(all_of(text, p)) for k, p in TAGS.items()}
    strict = F.size(all_of(text, STRICT_TAG))
    whole = F.size(F.filter(all_of(text, STRICT_TAG), lambda s: s.rlike("^(?:" + "|".join(TAGS.values()) + ")$")))
    return docs.select("doc_id", *[c.alias(k) for k, c in counts.items()], (strict - whole).alias("malformed"), (F.size(all_of(text, ANY_TAG)) - strict).alias("miscased"))


def citations(docs: DataFrame) -> DataFrame:
    """(doc_id, source, nth, path, line): the evidence tags of each document; line null if none is named."""
    tags = F.posexplode(F.regexp_extract_all("text", F.lit(r"\[Evidenced — ([^\];]+?)(?:; inference avoided beyond this)?\]"), 1))
    rows = docs.where("text is not null").select("doc_id", "source", tags.alias("nth", "cited"))
    line = F.regexp_extract("cited", r":(\d+)$", 1)
    return rows.select("doc_id", "source", "nth", posix(F.regexp_replace("cited", r":\d+$", "")).alias("path"), F.when(line != "", line).try_cast("int").alias("line"))


def resolved(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, nth, path, line, verdict): citations that resolve, whose file is missing, or that point past its end.

    A citation names a path, or the end of one from a directory on, in the document's source (repo); of several such files
    the longest counts. Paths meet in an equi-join on the ends of the files' paths.
    """
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    size = F.size(F.split(F.regexp_replace("content", "\n$", ""), "\n"))
    known = with_path(files).where("content is not null").select("repo", F.explode(ends).alias("end"), size.alias("lines"))
    longest = known.groupBy("repo", "end").agg(F.max("lines").alias("lines"))
    met = citations(docs).alias("c").join(longest.alias("k"), (F.col("c.source") == F.col("k.repo")) & (F.col("c.path") == F.col("k.end")), "left")
    verdict = F.when(F.col("lines").isNull(), "missing").when(F.col("line") > F.col("lines"), "past the end").otherwise("resolved")
    return met.select("doc_id", "nth", "c.path", "line", verdict.alias("verdict"))


def resolve_citations(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(verdict, n): how many citations resolve."""
    return resolved(docs, files).groupBy("verdict").agg(F.count("*").alias("n"))


def clause(prefix: Column) -> Column:
    """The last sentence of what stands before a tag."""
    return F.element_at(F.split(prefix, r"(?<=[.!?])\s+"), -1)


def tagged_claims(docs: DataFrame, kind: str = "confirmed") -> DataFrame:
    """(doc_id, nth, claim): the clause before each tag of a kind; a clause begins after the tag or line before it."""
    before = F.regexp_extract_all("text", F.lit(r"([^\n\]]*)" + TAGS[kind]), 1)
    rows = docs.where("text is not null").select("doc_id", F.posexplode(before).alias("nth", "prefix"))
    return rows.select("doc_id", "nth", F.trim(clause(F.rtrim("prefix"))).alias("claim")).where("claim <> ''")


#: Identifiers that a claim would share with the source it cites.
SYMBOLS = (r"@[A-Z]\w+", r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b", r"\b[a-z]\w*(?=\(\))", r"\b[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)+\b", r"\b[a-z][a-z0-9_-]*(?:\.[a-z0-9_-]+){2,}\b")


def claim_symbols(text: Column) -> Column:
    """The identifiers in a claim, sorted; of method calls the bare name."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[all_of(F.replace(text, F.lit("`"), F.lit("")), p) for p in SYMBOLS]))))


def claim_units(docs: DataFrame) -> DataFrame:
    """(doc_id, line, sentence) that may carry a claim: outside fences, no headings, table rules, comments, quotes or blank lines.

    A line is inside a fence if an odd number of fence lines stand above it; texts stay in their row.
    """
    lines = F.transform(F.split(F.regexp_replace("text", "\r", ""), "\n"), lambda x, i: F.struct(x.alias("t"), (i + 1).alias("n")))
    fences = F.transform(F.filter(lines, lambda x: x["t"].rlike(r"^\s*(```|~~~)")), lambda x: x["n"])
    rows = spread(docs.where("text is not null").select("doc_id", "text")).select("doc_id", lines.alias("lines"), fences.alias("fences"))
    outside = lambda x: (F.size(F.filter("fences", lambda f: f < x["n"])) % 2 == 0) & ~F.array_contains("fences", x["n"])
    plain = lambda x: ~x["t"].rlike(r"^\s*($|#{1,6}\s|\|?[\s:|-]+\|?\s*$|<!--|>)")
    kept = rows.select("doc_id", F.explode(F.filter("lines", lambda x: plain(x) & outside(x))).alias("l"))
    body = F.trim(F.regexp_replace("l.t", r"^\s*(?:[-*+]|\d+[.)])\s+", ""))
    rows = kept.select("doc_id", F.col("l.n").alias("line"), F.explode(F.split(body, r"(?<=[.!?])\s+")).alias("sentence"))
    return rows.withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


def untagged_claims(docs: DataFrame) -> DataFrame:
    """(doc_id, line, sentence, artifacts) of sentences that name an artifact and carry no tag in any casing."""
    bare = F.regexp_replace(F.regexp_replace("sentence", r"https?://\S+", " "), "`", "")
    found = F.array_sort(F.array_distinct(F.flatten(F.array(*[all_of(bare, p) for p in ARTIFACTS]))))
    rows = claim_units(docs).where(~F.col("sentence").rlike(ANY_TAG)).withColumn("artifacts", found)
    return rows.where("size(artifacts) > 0")


def word_set(text: Column) -> Column:
    """Distinct lower-case words of two letters or more, stop words aside."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def closest(left: DataFrame, right: DataFrame, least: float = 0.15) -> DataFrame:
    """(left_id, right_id, overlap): for each left text the right one of greatest word overlap (Jaccard) of at least `least`.

    left and right: (id, text). Texts meet in an equi-join on their rarest words: a pair of overlap t shares one of the
    |words| - ceil(t * |words|) + 1 rarest words of either side, so no pair is missed and no cross join is made. Texts with the same
    words are one class: the smallest id of the right class counts, and each left row gets its class's result. Ties: the smaller id.
    """
    every = left.select("id", F.array_sort(word_set(F.col("text"))).alias("a")).where("size(a) > 0")
    a = every.groupBy("a").agg(F.min("id").alias("left_id"))
    b = right.select("id", F.array_sort(word_set(F.col("text"))).alias("b")).where("size(b) > 0").groupBy("b").agg(F.min("id").alias("right_id"))
    freq = a.select(F.explode("a").alias("w")).unionByName(b.select(F.explode("b").alias("w"))).groupBy("w").agg(F.count("*").alias("df"))

    def prefixed(df: DataFrame, i: str, words: str) -> DataFrame:
        ranked = df.select(i, F.explode(words).alias("w")).join(freq, "w").groupBy(i).agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
        take = F.size("o") - F.ceil(F.lit(least) * F.size("o")).cast("int") + 1
        return ranked.select(i, F.explode(F.transform(F.slice("o", 1, take), lambda x: x["w"])).alias("w"))

    pairs = prefixed(a, "left_id", "a").join(prefixed(b, "right_id", "b"), "w").select("left_id", "right_id").distinct()
    both = pairs.join(a, "left_id").join(b, "right_id")
    overlap = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    scored = both.select("left_id", "right_id", overlap.alias("overlap")).where(F.col("overlap") >= least)
    best = scored.groupBy("left_id").agg(F.max(F.struct("overlap", (-F.col("right_id")).alias("r"))).alias("m")).join(a, "left_id")
    return every.join(best.select("a", "m"), "a").select(F.col("id").alias("left_id"), (-F.col("m.r")).alias("right_id"), "m.overlap")


def diagrams(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, squares, parens, braces, quotes, undefined): faults of fenced flow charts; 0 and empty where there is none.

    squares, parens and braces: opening less closing marks; quotes: 1 if odd; undefined: ends of edges that no label declares.
    """
    body = F.regexp_extract_all(F.regexp_replace("text", "\r", ""), F.lit(r"(?s)```mermaid\n(.*?)```"), 1)
    rows = docs.where(F.col("text").contains("```mermaid")).select("doc_id", F.posexplode(body).alias("nth", "d"))
    n = lambda ch: F.length("d") - F.length(F.replace("d", F.lit(ch), F.lit("")))
    declared = F.regexp_extract_all("d", F.lit(r"\b([A-Za-z_]\w*)\s*(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})"), 1)
    edge = r"\b([A-Za-z_]\w*)\s*(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})?\s*(?:--+>|--+|-\.+->?|==+>?)\s*(?:\|[^|]*\|\s*)?([A-Za-z_]\w*)\b"
    ends = F.array_union(F.regexp_extract_all("d", F.lit(edge), 1), F.regexp_extract_all("d", F.lit(edge), 2))
    return rows.select("doc_id", "nth", (n("[") - n("]")).alias("squares"), (n("(") - n(")")).alias("parens"), (n("{") - n("}")).alias("braces"), (n('"') % 2).alias("quotes"), F.array_sort(F.array_except(ends, declared)).alias("undefined"))
