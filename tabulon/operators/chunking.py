"""Cutting texts into overlapping chunks and describing each chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.errors import InvalidRequest
from tabulon.functions.schema import col, require_columns
from tabulon.functions.text import keywords, numbers, row_text, strip, word_count
from tabulon.operators.ordering import forward_fill, row_numbers

# Chunk size and overlap in characters, size marks, rows per document, patterns.
CHUNK_SIZE = 900
CHUNK_OVERLAP = 120
MAX_TEXT_BYTES = 2_000_000
MAX_CHUNKS = 200
ROWS_PER_DOCUMENT = 5000
HEADING_CHARS = 120
PARAGRAPH_BREAK = r"(?U)\n\s*\n"
HEADING = r"(?sU)^(#{1,6})\s+(.+)$"
PAGE_LINE = r"(?iU)^\[(?:Страница|Page)\s+(\d+)\]"
ROW_LINE = r"(?iU)^(?:Строка|Row)\s+(\d+):"
CAPITAL = r"[A-ZА-ЯЁ]"
MARKS = ("section_title", "section_level", "page_number", "row_number")


def _windows(paragraph: Column, size: int, overlap: int) -> Column:
    """A long paragraph as windows of ``size`` characters, each ``overlap`` into the last.

    One pass cuts the paragraph into pieces as long as a window's step, and a window is put together
    from the pieces it begins with: taking each window out of the paragraph would walk to it from
    the paragraph's beginning.
    """
    step = size - overlap
    count = F.ceil(F.greatest(F.length(paragraph) - size, F.lit(0)) / step).cast("int")
    pieces = F.regexp_extract_all(paragraph, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def joined(found: Column) -> Column:
        whole = found
        for further in range(1, -(-size // step)):
            rest = F.slice(found, F.lit(further + 1), F.greatest(F.size(found), F.lit(1)))
            whole = F.zip_with(whole, rest, lambda head, tail: F.concat_ws("", head, tail))
        return F.transform(F.slice(whole, F.lit(1), count + 1), lambda piece: strip(F.substring(piece, 1, size)))

    # An entry of an array, so that the paragraph is cut up once and not for each use of its pieces.
    cut = F.transform(F.array(pieces), joined)[0]
    return F.filter(cut, lambda piece: piece != "")


def chunk_bodies(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The chunks of a text as an array: paragraphs packed up to ``size`` characters, longer
    ones cut into windows."""
    if not 0 <= overlap < size:
        raise InvalidRequest("the overlap must be smaller than the chunk")
    clean = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"\n{3,}", "\n\n")
    paragraphs = F.filter(
        F.transform(F.split(clean, PARAGRAPH_BREAK), strip), lambda piece: piece != ""
    )
    nothing = F.array().cast("array<string>")

    def pack(state: Column, paragraph: Column) -> Column:
        open_text = state["open"]
        flushed = F.when(open_text != "", F.array(open_text)).otherwise(nothing)
        joined = F.when(open_text == "", paragraph).otherwise(F.concat(open_text, F.lit("\n\n"), paragraph))
        long, fits = F.length(paragraph) > size, F.length(joined) <= size
        return F.struct(
            F.when(long, F.concat(state["done"], flushed, _windows(paragraph, size, overlap)))
            .when(fits, state["done"])
            .otherwise(F.concat(state["done"], flushed))
            .alias("done"),
            F.when(long, F.lit("")).when(fits, joined).otherwise(paragraph).alias("open"),
        )

    start = F.struct(nothing.alias("done"), F.lit("").alias("open"))
    return F.aggregate(
        paragraphs, start, pack,
        lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]),
    )


def chunk_documents(
    documents: DataFrame,
    id_column: str,
    text_column: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    keep: Sequence[str] = (),
    context: bool = False,
) -> DataFrame:
    """One row per chunk: chunk_id, document id, chunk_index, text, char_count, word_count and,
    with ``context``, the metadata of ``chunk_context``.

    Each text is cut in the task that reads it; nothing is shuffled.
    """
    require_columns(documents, [id_column, text_column, *keep])
    bodies = chunk_bodies(col(text_column), size, overlap)
    cut = documents.select(
        col(id_column), *map(col, keep), F.posexplode(_with_marks(bodies) if context else bodies)
    )
    body = F.col("col.text") if context else F.col("col")
    return cut.select(
        F.concat_ws("-", col(id_column).cast("string"), F.col("pos").cast("string")).alias("chunk_id"),
        col(id_column),
        *map(col, keep),
        F.col("pos").cast("long").alias("chunk_index"),
        body.alias("text"),
        F.length(body).cast("long").alias("char_count"),
        word_count(body).alias("word_count"),
        *([_metadata(body, {m: F.col("col").getField(m) for m in MARKS}).alias("metadata")] if context else []),
    )


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _marks(text: Column) -> dict[str, Column]:
    """What the first line of a chunk says about section, page and row; null when nothing."""
    line = strip(F.substring_index(text, "\n", 1))
    shouted = (line != "") & (F.length(line) < HEADING_CHARS) & (line == F.upper(line)) & line.rlike(CAPITAL)
    return {
        "section_title": F.coalesce(strip(_group(line, HEADING, 2)), F.when(shouted, line)),
        "section_level": F.length(_group(line, HEADING, 1)).cast("long"),
        "page_number": _group(line, PAGE_LINE, 1).cast("long"),
        "row_number": _group(line, ROW_LINE, 1).cast("long"),
    }


def _with_marks(bodies: Column) -> Column:
    """Chunk bodies with the marks last seen in the same document, in one walk over the array."""
    nothing = F.array().cast("array<struct<text:string,section_title:string,section_level:long,page_number:long,row_number:long>>")

    def walk(done: Column, body: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))
        seen = [F.coalesce(mark, before[m]).alias(m) for m, mark in _marks(body).items()]
        return F.concat(done, F.array(F.struct(body.alias("text"), *seen)))

    return F.aggregate(bodies, nothing, walk)


def _metadata(text: Column, seen: dict[str, Column]) -> Column:
    return F.struct(
        *[c.alias(m) for m, c in seen.items()], numbers(text).alias("numbers"), keywords(text).alias("keywords")
    )


def chunk_context(chunks: DataFrame, id_column: str, index: str = "chunk_index", text: str = "text") -> DataFrame:
    """A stored chunk table with a ``metadata`` struct: numbers and keywords of the chunk, and the
    section, page and row marks last seen in its document. A document may hold most of the chunks."""
    require_columns(chunks, [id_column, index, text])
    marked = chunks.withColumns({f"__{m}": c for m, c in _marks(col(text)).items()})
    filled = forward_fill(marked, [index], [id_column], [f"__{m}" for m in MARKS])
    seen = {m: F.col(f"__{m}") for m in MARKS}
    return filled.withColumn("metadata", _metadata(col(text), seen)).drop(*[f"__{m}" for m in MARKS])


def size_flags(
    documents: DataFrame,
    id_column: str,
    text_column: str,
    max_bytes: int = MAX_TEXT_BYTES,
    max_chunks: int = MAX_CHUNKS,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Per document its bytes and chunks, and whether they pass the limits; no text is cut."""
    held = F.octet_length(col(text_column)).cast("long")
    pieces = F.size(chunk_bodies(col(text_column), size, overlap)).cast("long")
    return documents.select(col(id_column), held.alias("text_bytes"), pieces.alias("chunks")).withColumns(
        {"too_many_bytes": F.col("text_bytes") > max_bytes, "too_many_chunks": F.col("chunks") > max_chunks}
    )


def cap_chunks(chunks: DataFrame, index: str = "chunk_index", max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Only a document's first chunks, for callers that want the limit applied."""
    return chunks.filter(col(index) < max_chunks)


def rows_to_lines(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, label: str = "Row"
) -> DataFrame:
    """Every row as a line ``Row 7: name: value | …``, numbered in the given order."""
    names = list(columns or df.columns)
    require_columns(df, names)
    numbered = row_numbers(df, order_by)
    number = F.col("row_number").cast("string")
    return numbered.select(
        "row_number", F.concat(F.lit(f"{label} "), number, F.lit(": "), row_text(df, names)).alias("line")
    )


def lines_to_documents(lines: DataFrame, rows_per_document: int = ROWS_PER_DOCUMENT) -> DataFrame:
    """Numbered lines joined to texts of a fixed number of rows each."""
    part = F.floor((F.col("row_number") - 1) / rows_per_document).cast("long")
    gathered = F.array_sort(F.collect_list(F.struct("row_number", "line")))
    return lines.groupBy(part.alias("document")).agg(
        F.array_join(F.transform(gathered, lambda r: r["line"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("rows"),
    )
