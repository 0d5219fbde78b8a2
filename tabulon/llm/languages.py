"""Languages of texts, span by span: script ranges narrow the candidates of each word, Viterbi labels the words.

A word is a run of letters of one script. Its score for a language is the mean, over lengths of one to five, of the log
probabilities of its letter groups, counted in labelled texts; only languages that use the word's script are candidates.
The best path through a text pays for each switch of language, so that a few foreign words do not make a span.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.errors import InvalidRequest
from tabulon.llm.arrays import between, run_hashes, running, slices
from tabulon.llm.rows import over_texts, with_result

#: About so many labelled rows of each language are learned from: those whose hash of the id is low enough.
ROWS_PER_LANGUAGE = 4_000
#: A column with more values does not hold languages; it bounds what is learned, together with the next two.
MAX_LANGUAGES = 256
BUCKETS = 1 << 15  # groups of one length share so many counters
LENGTHS = (1, 2, 3, 4, 5)
#: What a switch of language costs, and how much one word can say for or against a language, in nats.
SWITCH, WORD = 12.0, 6.0
MIN_SHARE = 0.01  # of a language's letters, for a script to be one of its own
UNKNOWN = "und"

_UNIT = 1024  # scores are whole numbers of 1 / 1024 nat, so sums do not depend on their order
_BEYOND = -(1 << 40)  # score of a language that does not use the script
_TOP = 0x34000  # no letters from here on
_SLICE = 4 << 20

# Blocks of code points by script.
SCRIPTS = (
    ("Latin", ((0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("Devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Gurmukhi", ((0xA00, 0xA7F),)),
    ("Gujarati", ((0xA80, 0xAFF),)),
    ("Oriya", ((0xB00, 0xB7F),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Telugu", ((0xC00, 0xC7F),)),
    ("Kannada", ((0xC80, 0xCFF),)),
    ("Malayalam", ((0xD00, 0xD7F),)),
    ("Sinhala", ((0xD80, 0xDFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Lao", ((0xE80, 0xEFF),)),
    ("Tibetan", ((0xF00, 0xFFF),)),
    ("Myanmar", ((0x1000, 0x109F),)),
    ("Georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("Ethiopic", ((0x1200, 0x139F), (0x2D80, 0x2DDF))),
    ("Khmer", ((0x1780, 0x17FF),)),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF))),
    ("Han", ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x33FFF))),
)
_OTHER = len(SCRIPTS) + 1  # letters outside all blocks
_MARK = 255


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the script of a letter (0: no letter, ``_MARK``: a mark on the letter before), the lower case."""
    script, lower = np.zeros(_TOP + 1, np.uint8), np.arange(_TOP + 1, dtype=np.uint32)
    for c in range(_TOP):
        kind = unicodedata.category(chr(c))[0]
        script[c] = _OTHER if kind == "L" else _MARK if kind == "M" else 0
        if kind == "L" and len(chr(c).lower()) == 1:
            lower[c] = ord(chr(c).lower())
    for i, (_, blocks) in enumerate(SCRIPTS, 1):
        for first, last in blocks:
            inside = script[first : last + 1]
            inside[inside == _OTHER] = i
    return script, lower


@dataclass
class Words:
    """The words of several texts: code points in lower case, where each word lies, its text and its script."""

    letters: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    script: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Words:
        coded = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int64)
        points = np.minimum(np.frombuffer(b"".join(coded), np.uint32), _TOP)
        script_of, lower = _tables()
        kind = script_of[points]
        if len(kind):
            # A mark belongs to the letter before it; one without such a letter belongs to no word.
            solid = np.where(kind != _MARK, np.arange(len(kind)), 0)
            solid[offsets[:-1][offsets[:-1] < len(kind)]] = offsets[:-1][offsets[:-1] < len(kind)]
            kind = kind[np.maximum.accumulate(solid)]
            kind = np.where(kind == _MARK, 0, kind)
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        inside = kind[starts] > 0 if len(kind) else np.zeros(0, bool)
        starts, ends = starts[inside], ends[inside]
        return Words(lower[points], starts, ends, np.searchsorted(offsets, starts, "right") - 1, kind[starts], offsets)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One place of each different word, and which of these every word is."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        names = between(*running(self.letters), self.starts, self.ends)
        _, first, same = np.unique(names, return_index=True, return_inverse=True)
        return first, same

    def groups(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the buckets of all groups of letters of the words ``which``, edges included, and the word
        (a place in ``which``) each is of."""
        sizes = (self.ends - self.starts)[which] + 2
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(which)), sizes)
        inside = np.arange(len(word)) - (ends - sizes)[word]
        source = self.starts[which][word] + inside - 1
        edge = (inside == 0) | (inside == sizes[word] - 1)
        values = np.where(edge, np.where(inside == 0, 1, 2), self.letters[np.clip(source, 0, max(len(self.letters) - 1, 0))] if len(self.letters) else 0)
        values = values.astype(np.uint64)
        for i, length in enumerate(LENGTHS):
            if len(values) < length:
                continue
            hashes = run_hashes(values, length)
            whole = word[: len(hashes)] == word[length - 1 :]
            if length == 1:
                whole &= ~edge
            yield i, (hashes[whole] & np.uint64(BUCKETS - 1)).astype(np.int64), word[: len(hashes)][whole]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, the score of each bucket (length, bucket, language), and the scripts each language uses."""

    languages: tuple[str, ...]
    weights: np.ndarray
    uses: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Score of every word (row) for every language (column)."""
        first, same = words.distinct()
        total = np.zeros((len(first), len(self.languages)), np.int64)
        for i, bucket, word in words.groups(first):
            sums = np.zeros((len(bucket) + 1, len(self.languages)), np.int64)
            np.cumsum(self.weights[i][bucket], axis=0, out=sums[1:])
            total += sums[np.searchsorted(word, np.arange(len(first)), "right")] - sums[np.searchsorted(word, np.arange(len(first)), "left")]
        total //= len(LENGTHS)
        uses = self.uses[words.script[first]]
        uses = uses | ~uses.any(1, keepdims=True)
        total = np.where(uses, total, _BEYOND)
        total = np.maximum(total - total.max(1, keepdims=True), int(-WORD * _UNIT)) if len(total) else total
        return np.where(uses, total, _BEYOND)[same]


def best_paths(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: int) -> np.ndarray:
    """The language of every word on the best path through its text.

    Text i holds ``count[i]`` words from ``first[i]`` on. All texts take a step at once, longest first, so a step costs
    the same for one and for many. Staying wins over switching where both are as good, and the first language too.
    """
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return labels
    first, count = first[order], count[order]
    most = int(count[0])
    alive = np.searchsorted(-count, -np.arange(1, most), "left") if most > 1 else np.zeros(0, np.int64)  # with more than t words
    value = scores[first]
    left = np.zeros(scores.shape, bool)  # whether a word's language was reached by a switch
    source = np.zeros(len(scores), np.int16)  # and from which
    for t in range(1, most):
        n = alive[t - 1]
        now, at = value[:n], first[:n] + t
        best = now.argmax(1)
        entry = now[np.arange(n), best][:, None] - switch
        changed = now < entry
        left[at], source[at] = changed, best
        value[:n] = np.where(changed, entry, now) + scores[at]
    state = value.argmax(1)
    labels[first + count - 1] = state
    for t in range(most - 1, 0, -1):
        n = alive[t - 1]
        at, now = first[:n] + t, state[:n]
        state[:n] = np.where(left[at, now], source[at], now)
        labels[at - 1] = state[:n]
    return labels


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % folds == fold, F.lit(False))


def learn_languages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE
) -> LanguageModel:
    """Counts of letter groups by language, from labelled rows that are not held out.

    Rows without id, language or text teach nothing. Of each language about ``rows_per_language`` rows are taken, by the
    hash of the id, whole texts each; all are counted with Spark, and what reaches the driver has at most as many rows as
    languages times lengths times buckets. No rows: no languages. More than ``MAX_LANGUAGES`` values are an error.
    """
    known = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("lang"))
    known = known.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise InvalidRequest(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((len(LENGTHS), BUCKETS, 0), np.int32), np.zeros((_OTHER + 1, 0), bool))
    number = {name: i for i, name in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, rows_per_language / sizes[name]))])
    drawn = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53)
    sample = known.where(drawn < share[F.col("lang")]).select("t", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        width = len(LENGTHS) * BUCKETS + _OTHER + 1
        for batch in slices(batches, "t", _SLICE):
            names = np.array([number[x] for x in batch.column("lang").to_pylist()])
            for which in np.unique(names):
                words = Words.of(batch.column("t").filter(pa.array(names == which)).to_pylist())
                held = sums.setdefault(int(which), np.zeros(width, np.int64))
                first, same = words.distinct()
                times = np.bincount(same, minlength=len(first))
                for i, bucket, word in words.groups(first):
                    held[i * BUCKETS : (i + 1) * BUCKETS] += np.bincount(bucket, times[word], BUCKETS).astype(np.int64)
                letters = np.bincount(words.script, words.ends - words.starts, _OTHER + 1).astype(np.int64)
                held[len(LENGTHS) * BUCKETS :] += letters
        for which, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), which), pa.int32()), pa.array(at, pa.int32()), pa.array(held[at])], names=["l", "at", "n"]
            )

    counted = sample.mapInArrow(count, "l int, at int, n long").groupBy("l", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), len(LENGTHS) * BUCKETS + _OTHER + 1), np.int64)
    counts[counted["l"].to_numpy(), counted["at"].to_numpy()] = counted["n"].to_numpy()
    groups = counts[:, : len(LENGTHS) * BUCKETS].reshape(len(languages), len(LENGTHS), BUCKETS)
    # The same is added to every probability, so that a group seen nowhere speaks for no language.
    likely = groups / np.maximum(groups.sum(2, keepdims=True), 1) + 1 / (4 * BUCKETS)
    nats = np.log(likely)
    weights = np.round((nats - nats.mean(0)) * _UNIT).astype(np.int32).transpose(1, 2, 0)
    letters = counts[:, len(LENGTHS) * BUCKETS :]
    uses = (letters >= MIN_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)).T
    return LanguageModel(languages, np.ascontiguousarray(weights), uses)


def _of_texts(words: Words, scores: np.ndarray, labels: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the language of most letters (-1 without letters), and a number between 0 and 1: its share of the
    letters, times how likely its words are to be of it and not of another language."""
    n = len(words.offsets) - 1
    sizes = np.bincount(words.text * languages + labels, words.ends - words.starts, n * languages).reshape(n, languages)
    main = sizes.argmax(1)
    own = labels == main[words.text]
    evidence = np.zeros((n, languages))
    for l in range(languages):
        evidence[:, l] = np.bincount(words.text[own], np.maximum(scores[own, l], -int(WORD * _UNIT)), n) / _UNIT
    ahead = np.clip(evidence - evidence[np.arange(n), main][:, None], -700, 700)
    sure = 1 / np.exp(ahead).sum(1)
    whole = sizes.sum(1)
    share = np.divide(sizes[np.arange(n), main], whole, out=np.zeros(n), where=whole > 0)
    return np.where(whole > 0, main, -1), share * sure


def label_languages(
    docs: DataFrame, model: LanguageModel, switch: float = SWITCH, doc_id: str = "doc_id", text: str = "text", whole_rows: bool = False
) -> DataFrame:
    """Language of every text and of its spans.

    Columns: ``doc_id``, ``lang_pred`` (the language of most letters, of equal ones the first by name; ``und`` for texts that are
    null or without letters, or where no language was learned), ``score`` (0 to 1, 0 for ``und``) and ``spans`` (start, end in code points,
    end exclusive, and language of each longest run of words with one language); with ``whole_rows`` also ``row``, all
    columns of the input. Only the text is read, whole, each by itself and without a shuffle: repeated rows are labelled
    each, other columns are not looked at, an empty table has no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cost = int(switch * _UNIT)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        for batch in slices(batches, "t", _SLICE):
            n = batch.num_rows
            if not model.languages:
                arrays = [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(span))]
                yield with_result(batch, arrays, ["lang_pred", "score", "spans"])
                continue
            words = Words.of(batch.column("t").to_pylist())
            scores = model.scores(words)
            count = np.bincount(words.text, minlength=n)
            first = np.cumsum(count) - count
            labels = best_paths(scores, first, count, cost)
            main, sure = _of_texts(words, scores, labels, len(model.languages))
            opens = np.ones(len(labels), bool)
            opens[1:] = (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])
            opening = np.flatnonzero(opens)
            closing = np.append(opening[1:], len(labels))[: len(opening)] - 1
            of = words.text[opening]
            spans = pa.StructArray.from_arrays(
                [pa.array(words.starts[opening] - words.offsets[of]), pa.array(words.ends[closing] - words.offsets[of]), names.take(pa.array(labels[opening]))],
                fields=list(span),
            )
            ends = np.searchsorted(of, np.arange(n + 1), "left").astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), spans)
            yield with_result(batch, [names.take(pa.array(np.where(main < 0, len(model.languages), main))), pa.array(sure), listed], ["lang_pred", "score", "spans"])

    results = "lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    return over_texts(docs, run, results, doc_id, text, whole_rows)
