"""Keeping a chunk table: statistics, changes, reconciliation, retrieved context, repeats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.rounding import half_up
from tabulon.functions.schema import col, require_columns
from tabulon.functions.text import normalize, strip, word_count
from tabulon.operators.chunking import PARAGRAPH_BREAK
from tabulon.operators.joins import lookup_keys, unique_keys

# Preview widths, and the length from which containment counts.
PREVIEW_CHARS = 240
BRIEF_CHARS = 1200
CONTAINED_FROM = 51


def chunk_stats(chunks: DataFrame, document: str, char_count: str = "char_count") -> DataFrame:
    """One row: chunks, documents, mean characters per chunk."""
    per_document = chunks.groupBy(col(document)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(col(char_count)).alias("chars")
    )
    n, chars = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))
    return per_document.agg(
        n.cast("long").alias("chunks_total"),
        F.count(F.lit(1)).alias("documents_indexed"),
        half_up(chars / F.greatest(n, F.lit(1)), 1).alias("avg_chunk_chars"),
    )


def update_chunks(
    chunks: DataFrame, changes: DataFrame, id_column: str = "chunk_id", text: str = "text", metadata: str | None = None
) -> DataFrame:
    """Chunks with new texts and recounted sizes where ``changes`` (id, text) names them. With
    ``metadata``, a string map in both tables, the entries of the changes are merged in. An id that
    occurs twice among the changes is an error when the rows are computed."""
    given = [col(id_column), col(text).alias("__text")]
    if metadata is not None:
        given.append(col(metadata).alias("__metadata"))
    new = unique_keys(changes, [id_column]).select(*given)
    body = F.coalesce(F.col("__text"), col(text))
    fresh = {
        text: body,
        "char_count": F.length(body).cast("long"),
        "word_count": word_count(body),
    }
    if metadata is not None:
        merged = merge_metadata(col(metadata), col("__metadata"))
        fresh[metadata] = F.when(col("__metadata").isNull(), col(metadata)).otherwise(merged)
    joined = chunks.join(new, id_column, "left")
    return joined.select(*[fresh[c].alias(c) if c in fresh else col(c) for c in chunks.columns])


def merge_metadata(old: Column, new: Column) -> Column:
    """Two string maps as one; entries of the new one win."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(
        F.coalesce(old, empty), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(new, empty)), k)
    )
    return F.map_concat(kept, F.coalesce(new, empty))


def delete_rows(chunks: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Chunks whose key does not occur in ``gone``: by chunk id or by document."""
    return chunks.join(lookup_keys(gone, [key], [key]), key, "left_anti")


def replace_documents(
    chunks: DataFrame, fresh: DataFrame, document: str, replaced: DataFrame | None = None
) -> DataFrame:
    """The fresh chunks in place of all older chunks of the replaced documents, which are by
    default those with fresh chunks."""
    gone = fresh if replaced is None else replaced
    return delete_rows(chunks, gone, document).unionByName(fresh.select(*map(col, chunks.columns)))


def reconcile(chunks: DataFrame, vectors: DataFrame, id_column: str) -> DataFrame:
    """Ids only one of two tables has: ``missing_vector`` or ``orphan_vector``."""
    left = chunks.select(col(id_column)).distinct().withColumn("__chunk", F.lit(True))
    right = vectors.select(col(id_column)).distinct().withColumn("__vector", F.lit(True))
    both = left.join(right, id_column, "full")
    status = F.when(F.col("__vector").isNull(), "missing_vector").when(F.col("__chunk").isNull(), "orphan_vector")
    return both.select(col(id_column), status.alias("status")).filter(F.col("status").isNotNull())


def _hits_with_text(
    hits: DataFrame, chunks: DataFrame, id_column: str, text: str, title: str | None
) -> DataFrame:
    """(query_id, rank, id, score, title, body); a chunk without title shows its id.

    The planner decides from the size of the hits whether they travel to the texts.
    """
    few = hits.select("query_id", "id", "rank", "score")
    shown = col(id_column).cast("string")
    if title is not None:
        shown = F.coalesce(F.nullif(col(title).cast("string"), F.lit("")), shown)
    texts = chunks.select(col(id_column).alias("id"), shown.alias("title"), F.coalesce(col(text), F.lit("")).alias("body"))
    return texts.join(few, "id")


def _joined_blocks(found: DataFrame, block: Column, joiner: str) -> DataFrame:
    """The blocks of each query in rank order; a query has at most k of them."""
    gathered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("sources"),
        F.array_join(F.transform(gathered, lambda b: b["block"]), joiner).alias("context"),
    )


def retrieved_context(
    hits: DataFrame, chunks: DataFrame, id_column: str, text: str = "text", title: str | None = None
) -> DataFrame:
    """Per query the whole texts of its ranked hits, as numbered blocks with a line between them."""
    found = _hits_with_text(hits, chunks, id_column, text, title)
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), "title", F.lit(")\n"), "body")
    return _joined_blocks(found, block, "\n\n---\n\n")


def brief_context(
    hits: DataFrame, chunks: DataFrame, id_column: str, text: str = "text", title: str | None = None
) -> DataFrame:
    """The short form that goes beside a table summary: the opening of each hit."""
    found = _hits_with_text(hits, chunks, id_column, text, title)
    opening = F.substring("body", 1, BRIEF_CHARS)
    block = F.concat(F.lit("[K"), F.col("rank").cast("string"), F.lit("] "), "title", F.lit("\n"), opening)
    return _joined_blocks(found, block, "\n\n")


def hit_sources(
    hits: DataFrame, chunks: DataFrame, id_column: str, text: str = "text", title: str | None = None
) -> DataFrame:
    """One row per hit: rank, chunk, title, score and a preview."""
    found = _hits_with_text(hits, chunks, id_column, text, title)
    return found.select(
        "query_id", "rank", F.col("id").alias("chunk_id"), "title", "score",
        F.substring("body", 1, PREVIEW_CHARS).alias("preview"),
    )


def linked_documents(tables: DataFrame, chunks: DataFrame, table_id: str, source: str, document: str) -> DataFrame:
    """Documents made from a table, with their number of chunks."""
    per_document = chunks.filter(col(source).isNotNull()).groupBy(col(source), col(document)).agg(
        F.count(F.lit(1)).alias("chunk_count")
    )
    ids = lookup_keys(tables, [table_id], ["__table"])
    return per_document.join(ids, col(source) == F.col("__table"), "left_semi")


# --- repeated passages ------------------------------------------------------------------


# Fixed value: marks, number and title of a heading line.
HEADING = r"(?U)^\s*#+\s*(?:\d+\.\s*)?(.*)$"


def _heading_key(line: Column) -> Column:
    """What a heading is compared by: its title without number, stars and outer dots; empty for other lines."""
    title = F.translate(F.regexp_extract(line, HEADING, 1), "*", "")
    return F.btrim(normalize(title), F.lit("."))


def _first_repeat(keys: Column) -> Column:
    """Position of the first key that occurred before: equal keys lie side by side once sorted."""
    placed = F.array_sort(
        F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda e: e["k"] != "")
    )
    later = F.transform(placed, lambda e, i: F.when(F.get(placed, i - 1)["k"] == e["k"], e["i"]))
    return F.array_min(later)


_BASE = 0x9E3779B97F4A7C15
_PASSAGE_CHARS = 1 << 20


def _rolling(passages: list[str]) -> list[np.ndarray]:
    """For each passage a hash of every stretch of ``CONTAINED_FROM`` characters, found for all of them at once: the
    difference of two prefix sums, shifted to a common power of the base."""
    n = CONTAINED_FROM
    points = np.frombuffer("".join(passages).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(p) for p in passages])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if len(points) < n:
        return [np.zeros(0, np.uint64) for _ in passages]
    up = np.cumprod(np.full(len(points), _BASE, np.uint64))
    down = np.cumprod(np.full(len(points), pow(_BASE, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up)])
    hashes = (sums[n:] - sums[:-n]) * down[: len(points) - n + 1]
    return [hashes[a : max(a, b - n + 1)] for a, b in zip(starts.tolist(), ends.tolist())]


def _kept_passages(passages: list[str], pieces: list[np.ndarray] | None = None) -> int:
    """How many passages come before the first that repeats an earlier one: equal, or one
    contains the other and that has ``CONTAINED_FROM`` or more characters. A contained passage
    has its opening somewhere in the other one, so an index of openings and of inner pieces
    finds the candidates without comparing all pairs; texts decide."""
    pieces = _rolling(passages) if pieces is None else pieces
    lengths = [len(p) for p in pieces]
    inside = np.concatenate([np.zeros(0, np.uint64), *pieces])
    of = np.repeat(np.arange(len(pieces)), lengths)
    order = np.argsort(inside, kind="stable")
    inside, of = inside[order], of[order]
    opening = [p[0] for p in pieces if len(p)]
    # Passages whose opening stands in no other one can neither hold nor lie in another: their pieces are looked up at once.
    several = np.unique(np.array(opening, np.uint64))
    low, high = np.searchsorted(inside, several, "left"), np.searchsorted(inside, several, "right")
    shared = {int(h): sorted(set(of[a:b].tolist())) for h, a, b in zip(several, low, high) if b - a > 1}
    first: dict[str, int] = {}
    least = len(passages)
    for n, passage in enumerate(passages):
        if passage in first:
            least = min(least, n)
        elif passage:
            first[passage] = n
    for n, piece in enumerate(pieces):
        if len(piece):
            for other in shared.get(int(piece[0]), ()):
                # The shorter one is ``n``; the later of the two repeats the earlier.
                if other != n and max(n, other) < least and passages[n] in passages[other]:
                    least = max(n, other)
    return least


def _kept_of_batch(texts: Sequence[Sequence[str]]) -> list[int]:
    """``_kept_passages`` of many texts, hashed together some million characters at a time."""
    kept: list[int] = []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < _PASSAGE_CHARS):
            chars += sum(map(len, texts[end]))
            end += 1
        pieces = _rolling([p for text in texts[at:end] for p in text])
        done = 0
        for text in texts[at:end]:
            kept.append(_kept_passages(list(text), pieces[done : done + len(text)]))
            done += len(text)
        at = end
    return kept


def cut_repeats(
    df: DataFrame, text: str, paragraph_break: str = PARAGRAPH_BREAK, joiner: str = "\n\n", compared_chars: int | None = None
) -> DataFrame:
    """Texts up to the first repeated heading or paragraph, with the paragraphs before and after.
    Paragraphs are compared whole, or by their first ``compared_chars`` characters."""
    require_columns(df, [text])

    @F.pandas_udf("int")
    def kept(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(_kept_of_batch(part.tolist()), index=part.index, dtype="int32")

    lines = F.split(col("__body"), r"\r\n|\r|\n")
    repeat = F.when(col("__body").contains("#"), _first_repeat(F.transform(lines, _heading_key)))
    head = strip(F.array_join(F.slice(lines, 1, F.coalesce(col("__repeat"), F.lit(0))), "\n"))
    body = F.when(col("__repeat").isNull(), col("__body")).otherwise(head)
    staged = (
        df.withColumn("__body", strip(col(text)))
        .withColumn("__repeat", repeat)
        .withColumn("__parts", F.filter(F.transform(F.split(body, paragraph_break), strip), lambda p: p != ""))
    )
    shown = (lambda p: normalize(p)) if compared_chars is None else (lambda p: F.substring(normalize(p), 1, compared_chars))
    compared = F.transform(F.col("__parts"), shown)
    counted = staged.withColumn("__kept", kept(compared))
    return counted.withColumns(
        {
            "paragraphs": F.size("__parts").cast("long"),
            "kept_paragraphs": F.col("__kept").cast("long"),
            text: F.array_join(F.slice("__parts", 1, F.col("__kept")), joiner),
        }
    ).drop("__body", "__repeat", "__parts", "__kept")
