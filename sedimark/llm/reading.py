"""Reading level of prose by a Rasch-style latent model.

A document has one latent level theta, a word one difficulty b, both on the scale of the ratings: a word that is known at all levels
has a low difficulty, one that only demanding texts use a high one. Word w makes up a share r_w * sigma(SLOPE * (theta - b_w)) / Z(theta)
of a document's words, so levels are in order by construction. Documents and words are estimated in turn: given the difficulties, a
document's level has a posterior over the grid of levels; given the posteriors, each word's difficulty is the most likely one for its
expected occurrences at each level, which are sums over all documents. Rated documents keep the scale in place, with a weight
that leaves room for ratings that are off; unrated ones weigh less. Rounds end when the difficulties no longer move. Words are hashed
into a fixed number of buckets, so the item parameters are two arrays of a size that doesn't depend on the corpus; documents
never leave their partition.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.session import spread, staged

LEVELS = 5
#: Buckets of words of all languages.
BUCKETS = 1 << 18
#: Steepness of a word's occurrence over the levels, and the difficulties that are tried.
SLOPE = 3.0
DIFFICULTIES = np.arange(-0.5, 6.01, 0.125)
#: Rounds end when difficulties, weighted by their words' occurrences, move by less than this in the mean; after so many in any case.
MOVED, ROUNDS = 0.01, 12
#: Weight of an unrated document against a rated one.
UNRATED = 0.1
#: Words that count in full towards a document's posterior; longer documents are no more certain than this many words make them.
EVIDENCE_WORDS = 25
#: Weight of a rating against the model's own estimate of the rated document.
ANCHOR = 0.8
#: A word with fewer expected occurrences tells nothing.
LEAST_OCCURRENCES = 0.05
#: A document is prose if at least so many words stand in prose lines and this share of them is known to the model.
LEAST_WORDS, LEAST_KNOWN = 3, 0.5

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_INLINE = re.compile(r"`[^`\n]*`|https?://\S+|\[[^\]\n]*\]|<[^>\n]*>|\([^)\n]*\)")
_DATA = re.compile(r":\s*\"|^\S+:$|^[\w.-]+:\s")
_CODE = re.compile(r"[{}=<>\\]|;\s*$|\w\(|[^\W\d]\.[^\W\d]")
_COMMENT = ("//", "/*", "--", '"""')
_FILL = re.compile(r"[\s\d.,]+")
_WORD = re.compile(r"[^\W\d_]+")
#: A sentence after a label, as in minutes and interviews; keys of data are in lower case or have no sentence.
_LABELLED = re.compile(r"(?:[-*+]\s+|\*\*|__)?[^\W\d_a-zà-öø-ÿ][\w.-]*(?:\*\*|__)?:(?:\*\*|__)?\s+(\S.*[.!?…][\"'»”)*_]*)$")
_DOC_COMMENT = re.compile(r"(?s)/\*.*?(?:\*/|\Z)|\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z)")
#: What a run of prose lines in a text that is mostly code begins and ends with, and what it doesn't hold.
_SENTENCES = re.compile(r"(?s)(?:[-*+>]\s+|\d+[.)]\s+)?[\"'«“„¿¡*_]*[^\W\d_](?!.*\w_\w).*[.!?…:][\"'»”)*_]*\Z")


def prose_words(text: str | None) -> list[str]:
    """The words of a text's prose lines, in lower case.

    Fenced blocks, inline code, links, bracketed tags, markup, headings and tables are left out, and so are lines that read
    like code or data. A text of which such lines are the larger part (by characters) is judged by what prose it has: there only
    runs of lines that are sentences count, outside of comments, so that statements that happen to read like words don't.
    """
    if not text:
        return []
    text = _FENCE.sub("\n", text.replace("\r\n", "\n"))
    runs, mostly_prose = _runs(text)
    if not mostly_prose:
        runs = [(r, words) for r, words in _runs(_DOC_COMMENT.sub("\n", text))[0] if len(words) >= 4 and _SENTENCES.match(r)]
    return [w.lower() for _, words in runs for w in words]


def _runs(text: str) -> tuple[list[tuple[str, list[str]]], bool]:
    """(runs of prose lines with their words, whether they are at least as many characters as lines of code or data)."""
    runs: list[tuple[str, list[str]]] = []
    kept = lost = 0
    open_ = False
    for line in _INLINE.sub(" ", text).split("\n"):
        s = line.strip()
        if not s or s[0] in "|#":
            open_ = False
            continue
        if m := _LABELLED.match(s):
            s, open_ = m[1], False
        words = [] if line.startswith(("    ", "\t")) or s.startswith(_COMMENT) or _DATA.search(s) else _WORD.findall(s)
        if len(words) >= 3 and 8 * len(_CODE.findall(s)) <= len(words) and sum(map(len, words)) >= 0.6 * len(_FILL.sub("", s)):
            if open_:
                runs[-1] = (runs[-1][0] + "\n" + s, runs[-1][1] + words)
            else:
                runs.append((s, words))
            open_ = True
            kept += len(s)
        else:
            open_ = False
            if len(words) != 1 and len(words) != 2:
                lost += len(s)
    return runs, kept >= lost


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for batch in batches:
        words, counts = [], []
        for text in batch.column(1).to_pylist():
            got = Counter(prose_words(text))
            for w in got:
                if w not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen[w] = word_bucket(w)
            words.append([seen[w] for w in got])
            counts.append(list(got.values()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "words", "counts"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, words, counts): the word buckets of each document's prose; empty where there is none."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInArrow(_features, "doc_id bigint, words array<int>, counts array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(1)
    size = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(batch)), size), lists.flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)


def _posteriors(batch: pa.RecordBatch, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each document over the levels, whether it is prose)."""
    row, word, n = _flat(batch)
    rows = len(batch)
    total = np.bincount(row, weights=n, minlength=rows)
    known = words.known[word]
    of = np.bincount(row, weights=n * known, minlength=rows)
    share = np.log(_occurs(words.difficulty[word])) - words.norm[None]
    share[~known] = 0
    score = np.stack([np.bincount(row, weights=n * share[:, k], minlength=rows) for k in range(LEVELS)], axis=1)
    score *= (np.minimum(of, EVIDENCE_WORDS) / np.maximum(of, 1))[:, None]
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), (total >= LEAST_WORDS) & (of >= LEAST_KNOWN * total)


def _anchored(ratings: np.ndarray) -> np.ndarray:
    """Weights over the levels of a mean rating."""
    d = np.abs(np.arange(1, LEVELS + 1)[None] - ratings[:, None])
    q = 0.9 * np.clip(1 - d, 0, None) + 0.1 * np.exp(-1.5 * d)
    return q / q.sum(axis=1, keepdims=True)


def _occurs(difficulty: np.ndarray) -> np.ndarray:
    """sigma(SLOPE * (level - difficulty)) for each difficulty and level."""
    return 1 / (1 + np.exp(-SLOPE * (np.arange(1, LEVELS + 1)[None] - difficulty[..., None])))


@dataclass
class Words:
    """Item parameters: difficulty by bucket, whether the bucket tells anything, log of the normaliser by level."""

    difficulty: np.ndarray
    known: np.ndarray
    norm: np.ndarray


def item_step(sums: np.ndarray) -> Words:
    """The most likely difficulty of each word, from its expected occurrences at each level.

    The rate r_w that belongs to a difficulty is known in closed form, so each difficulty of the grid has a profile likelihood; words
    and the normaliser Z, which all words share, are settled in turn.
    """
    curve = _occurs(DIFFICULTIES)
    total, at_level, z = sums.sum(axis=1), sums.sum(axis=0), np.ones(LEVELS)
    seen = np.flatnonzero(total > 0)
    told = sums[seen] @ np.log(curve).T
    best = np.zeros(len(seen), np.int64)
    for _ in range(50):
        exposed = curve @ (at_level / z)
        best = (told - total[seen, None] * np.log(np.maximum(exposed, 1e-300))[None] - 0.02 * np.abs(DIFFICULTIES - 3)[None]).argmax(axis=1)
        new = ((total[seen] / np.maximum(exposed[best], 1e-300))[:, None] * curve[best]).sum(axis=0)
        new /= max(new.mean(), 1e-300)
        moved, z = np.abs(new - z).max(), np.maximum(new, 1e-9)
        if moved < 1e-4:
            break
    difficulty = np.full(len(sums), 3.0)
    difficulty[seen] = DIFFICULTIES[best]
    return Words(difficulty, total >= LEAST_OCCURRENCES, np.log(z))


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Words:
    """The item parameters of all word buckets, from (doc_id, words, counts, rating) rows.

    The first round learns from rated documents alone. Each round is one pass: every task sums its documents' expected occurrences
    by bucket and level, the sums of all tasks are added by bucket, and at most BUCKETS rows reach the driver.
    """
    sc = rows.sparkSession.sparkContext
    schema = "bucket int, " + ", ".join(f"s{k} double" for k in range(LEVELS))
    words: Words | None = None
    for _ in range(rounds + 1):
        shared = sc.broadcast(words)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((BUCKETS, LEVELS))
            for batch in batches:
                rating = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                rated = ~np.isnan(rating)
                if shared.value is None:
                    q = np.zeros((len(batch), LEVELS))
                    q[rated] = _anchored(rating[rated])
                else:
                    p, is_prose = _posteriors(batch, shared.value)
                    q = UNRATED * p
                    q[~is_prose] = 0
                    q[rated] = ANCHOR * _anchored(rating[rated]) + (1 - ANCHOR) * p[rated]
                row, word, n = _flat(batch)
                at, of = np.unique(word, return_inverse=True)
                for k in range(LEVELS):
                    acc[at, k] += np.bincount(of, weights=n * q[row, k], minlength=len(at))
            at = np.flatnonzero(acc.sum(axis=1) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(acc[at, k]) for k in range(LEVELS)]], ["bucket", *[f"s{k}" for k in range(LEVELS)]])

        got = rows.mapInArrow(sums, schema).groupBy("bucket").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(LEVELS)]).toPandas()
        total = np.zeros((BUCKETS, LEVELS))
        total[got["bucket"].to_numpy(np.int64)] = got[[f"s{k}" for k in range(LEVELS)]].to_numpy(float)
        before, words = words, item_step(total)
        if before is not None and (np.abs(words.difficulty - before.difficulty) * total.sum(axis=1)).sum() <= MOVED * total.sum():
            break
    return words


def rated_features(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Features with each document's mean rating (null if unrated), written to the shared folder for the passes that follow."""
    mean = ratings.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("reading_level").cast("double")).alias("rating"))
    return staged(features(docs).join(mean, "doc_id", "left"))


def levels(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, level DOUBLE, reading_level INT, p_hard DOUBLE): the estimated level of each document.

    `level` is the posterior mean, `reading_level` the rounded one, `p_hard` the probability of level 4 or 5. All three are
    null for documents without prose (null, empty, blank and code texts, data) and if there are no ratings to set the scale.
    Each row of `docs` gives one row; whole texts count. Rated documents get the model's estimate, not their rating.
    """
    rows = rated_features(docs, ratings)
    shared = rows.sparkSession.sparkContext.broadcast(fit(rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, is_prose = _posteriors(batch, shared.value)
            level = p @ np.arange(1, LEVELS + 1)
            none = ~is_prose
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(level, mask=none), pa.array(np.rint(level).astype(np.int32), mask=none), pa.array(p[:, 3:].sum(axis=1), mask=none)],
                ["doc_id", "level", "reading_level", "p_hard"],
            )

    return rows.mapInArrow(score, "doc_id bigint, level double, reading_level int, p_hard double")


def hard(leveled: DataFrame) -> DataFrame:
    """(doc_id): documents more likely of level 4 or 5 than below."""
    return leveled.where("p_hard >= 0.5").select("doc_id")


def profile(leveled: DataFrame, docs: DataFrame, by: str = "doc_type") -> DataFrame:
    """(by, reading_level, n_docs, mean_level): the corpus by level; null levels are texts without prose."""
    return leveled.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), by), "doc_id").groupBy(by, "reading_level").agg(F.count("*").alias("n_docs"), F.avg("level").alias("mean_level"))
