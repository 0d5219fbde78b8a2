"""Toxicity by a weighted lexicon: learned from labelled rows, matched by one Aho-Corasick automaton."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.rows import over_texts, with_result
from tabulon.session import computed_once

# At most so many labelled rows are learned from (those with the smallest hash of the id), and so many entries are kept.
TRAINING_ROWS = 20_000
ENTRIES = 20_000
MIN_TOXIC = 3  # toxic rows an entry must occur in
MIN_EVIDENCE = 12.0  # log-likelihood ratio an entry must have
MIN_CLEAN = 5  # clean rows that make a word an exception to a shorter entry
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings that may become entries

# Code points that look like Latin letters, and marks that stand for letters in a word.
HOMOGLYPHS = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})

_LOOKALIKE = re.compile("[Ͱ-ԯａ-ｚ]")
_MARKED = re.compile(r"(?<![\w@$!])[^\W0134578]*+[0134578@$!][\w@$!]*+")  # a word with a mark, found in one go
_GAP = re.compile(r"[\W_]+")


def _undone(word: re.Match) -> str:
    """A word that holds a letter, its marks taken for letters wherever they stand; ``!`` at its end is punctuation."""
    core = word[0].rstrip("!")
    return core.translate(DIGITS) if any(c.isalpha() for c in core) else word[0]


def folded(text: str | None) -> str:
    """The words in lower case with look-alikes and substitutions undone, a blank on either side of each."""
    text = (text or "").lower()
    if _LOOKALIKE.search(text):
        text = text.translate(HOMOGLYPHS)
    return " " + _GAP.sub(" ", _MARKED.sub(_undone, text)).strip() + " "


def features(line: str) -> set[str]:
    """Whole words (blank on both sides) and beginnings of words (blank in front)."""
    found = set()
    for word in set(line.split()):
        found.add(f" {word} ")
        for k in STEMS:
            if len(word) >= k:
                found.add(f" {word[:k]}")
    return found


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, phrases inside which entries do not count, and what turns a sum into a probability."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    slope: float = 0.0
    bias: float = 0.0


class Scorer:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry in sorted(lexicon.exceptions | lexicon.weights.keys()):
            self.automaton.add_word(entry, entry)
        if len(self.automaton):
            self.automaton.make_automaton()

    def evidence(self, text: str | None) -> float:
        """Weights of all entries found outside exceptions, each counted once, for every root of 100 words."""
        if not len(self.automaton):
            return 0.0
        line = folded(text)
        seen, spared = [], []
        for end, entry in self.automaton.iter(line):
            (spared if entry in self.lexicon.exceptions else seen).append((end - len(entry) + 1, end, entry))
        if spared:
            spared.sort()
            starts, reach = [x for x, _, _ in spared], list(accumulate((y for _, y, _ in spared), max))
            seen = [(a, b, e) for a, b, e in seen if not (k := bisect_right(starts, a)) or reach[k - 1] < b]
        if not seen:
            return 0.0
        total = math.fsum(self.lexicon.weights[e] for e in {e for _, _, e in seen})
        return total / math.sqrt(1 + (line.count(" ") - 1) / 100)

    def score(self, text: str | None) -> float:
        z = self.lexicon.slope * self.evidence(text) + self.lexicon.bias
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _calibrated(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton steps with a little shrinkage."""
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
    at = np.array([0.0, math.log(rate / (1 - rate))])
    x = np.column_stack([evidence, np.ones(len(evidence))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (p - toxic) + np.array([1e-3 * at[0], 0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9]), slope)
        at -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", training_rows: int = TRAINING_ROWS, entries: int = ENTRIES,
) -> Lexicon:
    """A lexicon from labelled rows that are not held out.

    Whole words and beginnings of words are counted by class with Spark; those with enough evidence for toxic rows
    become entries, weighted by their log odds. A word that only clean rows use, though a shorter entry matches it,
    becomes an exception, as do the phrases given. Rows without id, label or text teach nothing. No toxic rows or
    no clean rows: an empty lexicon that gives every text the same score.
    The sample is bounded by ``training_rows`` ids (those with the smallest hashes) with one row each, so its ids may be
    sent to all tasks and its sums to the driver: of repeated ids the smallest text counts, and it is toxic if any label
    says so. The lexicon keeps at most ``entries`` entries, those with most evidence, and as many learned exceptions.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic"))
    known = known.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("id"))
    chosen = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(training_rows)
    given = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    labelled = given.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = computed_once(labelled.select("text", (F.col("toxic") > 0).alias("toxic")))
    n = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("toxic")).first()
    toxic, clean = n["toxic"], n["n"] - n["toxic"]
    if not toxic or not clean:
        rate = (toxic + 0.5) / (toxic + clean + 1)
        return Lexicon({}, frozenset(), 0.0, math.log(rate / (1 - rate)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = (Counter(), Counter())
            for text, is_toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                sums[is_toxic].update(features(folded(text)))
            names = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([side[x] for x in names], pa.int64()) for side in reversed(sums))],
                names=["entry", "toxic", "clean"],
            )

    counts = sample.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    counts = computed_once(counts.where((F.col("toxic") >= MIN_TOXIC) | (F.col("clean") >= MIN_CLEAN)))
    rate = toxic / (toxic + clean)
    both = F.col("toxic") + F.col("clean")
    gain = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (both * rate))
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - rate)))).otherwise(0.0)
    )
    weight = F.log((F.col("toxic") + rate) / (toxic + 1)) - F.log((F.col("clean") + 1 - rate) / (clean + 1))
    kept = (
        counts.where((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") > both * rate))
        .withColumn("gain", gain).withColumn("weight", weight).where(F.col("gain") > MIN_EVIDENCE)
        .orderBy(F.desc("gain"), "entry").limit(entries)
    )
    weights = {r["entry"]: r["weight"] for r in kept.select("entry", "weight").collect()}
    stems = docs.sparkSession.createDataFrame([(e,) for e in sorted(weights) if not e.endswith(" ")], "stem string")
    words = counts.where((F.col("toxic") == 0) & (F.col("clean") >= MIN_CLEAN) & F.col("entry").endswith(" "))
    spared = (
        words.withColumn("stem", F.explode(F.array(*[F.substring("entry", 1, k + 1) for k in STEMS])))
        .join(F.broadcast(stems), "stem", "left_semi").groupBy("entry").agg(F.max("clean").alias("clean"))
        .orderBy(F.desc("clean"), "entry").limit(entries)
    )
    phrases = {r["entry"] for r in spared.collect()} | {folded(x) for x in exceptions}
    draft = Lexicon(weights, frozenset(phrases - weights.keys()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(draft)
        for batch in batches:
            found = [scorer.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("toxic")], names=["evidence", "toxic"])

    rows = sample.mapInArrow(measure, "evidence double, toxic boolean").orderBy("evidence", "toxic").collect()
    slope, bias = _calibrated(np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows]))
    return Lexicon(draft.weights, draft.exceptions, slope, bias)


def score_documents(
    docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text", whole_rows: bool = False
) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row; with ``whole_rows`` also ``row``, all its columns.

    Only the text decides. Null or empty texts have no entries and get the score of a text without any; texts are
    read whole and independently, without a shuffle; repeated rows are scored each; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = pa.array([scorer.score(t) for t in batch.column("t").to_pylist()], pa.float64())
            yield with_result(batch, [found], ["score"])

    return over_texts(docs, run, "score double", doc_id, text, whole_rows)
