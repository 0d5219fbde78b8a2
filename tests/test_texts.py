import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as strategy
from pyspark.sql import functions as F

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.functions import text as tx
from tabulon.operators.chunking import (
    cap_chunks, chunk_bodies, chunk_context, chunk_documents, lines_to_documents, rows_to_lines, size_flags,
)
from tabulon.operators.chunkstore import (
    _kept_passages, brief_context, chunk_stats, cut_repeats, delete_rows, hit_sources, linked_documents, merge_metadata, reconcile,
    replace_documents, retrieved_context, update_chunks,
)
from tabulon.operators.lexical import chunk_scores, list_chunks


def expected_chunks(text, size, overlap):
    """A plain loop over paragraphs, kept apart from the expression under test."""
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]
    out, current = [], []

    def flush():
        if current:
            out.append("\n\n".join(current))
            current.clear()

    for p in paragraphs:
        if len(p) > size:
            flush()
            start = 0
            while True:
                out.append(p[start : start + size].strip())
                if start + size >= len(p):
                    break
                start += size - overlap
        elif len("\n\n".join([*current, p])) <= size:
            current.append(p)
        else:
            flush()
            current.append(p)
    flush()
    return [c for c in out if c]


def chunk_texts(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in chunk_documents(df, "id", "text", size, overlap).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["text"])
    return [got.get(i, []) for i in range(len(texts))]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=strategy.lists(strategy.text(alphabet="ab é\n#", max_size=160), min_size=1, max_size=30),
    size=strategy.integers(4, 30), data=strategy.data(),
)
def test_chunks_of_any_text(spark, texts, size, data):
    overlap = data.draw(strategy.integers(0, size - 1))
    assert chunk_texts(spark, texts, size, overlap) == [expected_chunks(t, size, overlap) for t in texts]


def test_chunk_sizes_of_long_documents(spark):
    random.seed(7)
    words = ["word" * random.randrange(1, 4) for _ in range(20_000)]
    text = "\n\n".join(" ".join(words[i : i + 90]) for i in range(0, 20_000, 90)) + "\n\n" + "x" * 5000
    assert chunk_texts(spark, [text, "", None], 900, 120) == [expected_chunks(text, 900, 120), [], []]


def test_overlap_must_be_smaller(spark):
    with pytest.raises(InvalidRequest):
        chunk_documents(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text", 10, 10)


MARKED = "\n\n".join([
    "# Introduction  ", "first 1,5 and 20 words", "SECOND PART OF IT", "plain text goes on here", "## Deep section",
    "[Page 7] on seven", "Row 12: value 3.5x", "[Page x] is no mark",
])


def test_context_is_carried_along(spark):
    df = spark.createDataFrame([(1, MARKED), (2, "nothing special")], "id long, text string")
    inside = chunk_documents(df, "id", "text", 25, 5, context=True)
    meta = {(r["id"], r["chunk_index"]): r["metadata"] for r in inside.collect()}
    seen = [tuple(meta[(1, i)])[:4] for i in range(8)]
    assert seen == [
        ("Introduction", 1, None, None), ("Introduction", 1, None, None),
        ("SECOND PART OF IT", 1, None, None), ("SECOND PART OF IT", 1, None, None),
        ("Deep section", 2, None, None), ("Deep section", 2, 7, None), ("Deep section", 2, 7, 12), ("Deep section", 2, 7, 12),
    ]
    assert meta[(1, 1)]["numbers"] == ["1,5", "20"]
    assert meta[(2, 0)]["section_title"] is None and len(meta) == 9
    stored = chunk_documents(df, "id", "text", 25, 5)
    assert rows(chunk_context(stored, "id").select("chunk_id", "metadata")) == rows(inside.select("chunk_id", "metadata"))


def test_numbers_and_keywords(spark):
    df = spark.createDataFrame([("Ab 1,5 x2 3 4.5.6 12a 7é ٣ Straße straße 12345 under_score the",)], "t string")
    row = df.select(tx.numbers(F.col("t")), tx.keywords(F.col("t")), tx.tokens(F.col("t"))).first()
    assert row[0] == re.findall(r"\b\d+(?:[.,]\d+)?\b", df.first()[0])
    assert row[1] == ["straße", "under_score"]
    assert row[2] == ["ab", "x2", "12a", "7é", "straße", "straße", "12345", "under_score", "the"]


@pytest.mark.parametrize("value", [0.0, 1.0, -2.5, 1234.5, 12345.678, 0.00012344, 0.000012, 1e20, 99999.0, 9999.5, 3.14159, -0.5, 1e-300])
def test_four_digits(spark, value):
    shown = spark.range(1).select(tx.four_digits(F.lit(value))).first()[0]
    assert float(shown) == float(f"{value:.4g}") and len(shown) == len(f"{value:.4g}")


def test_rows_as_lines(spark):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 12345.678)], "i long, s string, x double")
    lines = rows_to_lines(df, ["i"], label="Zeile")
    assert rows(lines) == [(1, "Zeile 1: i: 1 | s: a | x: 1.235e+04"), (2, "Zeile 2: i: 2 | s: b | x: —")]
    assert rows(lines_to_documents(lines, 1), "document", "rows") == [(0, 1), (1, 1)]
    assert lines_to_documents(lines).first()["text"].count("\n") == 1


def test_cells_are_shortened(spark):
    out = spark.createDataFrame([("x" * 81,), ("y" * 80,), (None,)], "s string").select(tx.truncate_cell(F.col("s")))
    assert rows(out) == [(None,), ("x" * 79 + "…",), ("y" * 80,)]


def test_flat_metadata(spark):
    df = spark.createDataFrame([((1, None, ["a", "b"]),)], "m struct<page:long,title:string,keys:array<string>>")
    assert df.select(tx.flat_metadata(df, "m")).first()[0] == {"page": "1", "keys": '["a","b"]'}


def test_size_flags_cut_nothing(spark):
    df = spark.createDataFrame([(1, "x" * 2000), (2, "é")], "id long, text string")
    assert rows(size_flags(df, "id", "text", 100, 2)) == [(1, 2000, 3, True, True), (2, 2, 1, False, False)]
    chunks = chunk_documents(df, "id", "text")
    assert cap_chunks(chunks, max_chunks=1).count() == 2


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(
        [("old-1", 1, 0, "alpha beta", 10, 2), ("old-2", 1, 1, "Beta", 4, 1), ("new-1", 2, 0, "gamma", 5, 1)],
        "chunk_id string, doc long, chunk_index long, text string, char_count long, word_count long",
    )


def test_chunk_changes(spark, chunks):
    ids = spark.createDataFrame([("old-1",), ("old-2",), ("old-2",)], "chunk_id string")
    assert rows(delete_rows(chunks, ids, "chunk_id"), "chunk_id") == [("new-1",)]
    changes = spark.createDataFrame([("new-1", "one two three")], "chunk_id string, text string")
    assert rows(update_chunks(chunks, changes).filter("doc = 2"), "text", "char_count", "word_count") == [("one two three", 13, 3)]
    fresh = chunks.filter("chunk_id = 'old-2'").withColumn("chunk_id", F.lit("fresh"))
    assert rows(replace_documents(chunks, fresh, "doc"), "chunk_id") == [("fresh",), ("new-1",)]
    assert rows(chunk_stats(chunks, "doc")) == [(3, 2, 6.3)]
    assert rows(chunk_stats(chunks.limit(0), "doc")) == [(0, 0, 0.0)]


def test_metadata_merge(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS old, map('b', '3') AS new, CAST(NULL AS map<string,string>) AS none")
    merged = df.select(merge_metadata(F.col("old"), F.col("new")), merge_metadata(F.col("old"), F.col("none"))).first()
    assert merged[0] == {"a": "1", "b": "3"} and merged[1] == {"a": "1", "b": "2"}


def test_reconcile_and_links(spark, chunks):
    vectors = spark.createDataFrame([("old-1",), ("lost",)], "chunk_id string")
    assert rows(reconcile(chunks, vectors, "chunk_id")) == [
        ("lost", "orphan_vector"), ("new-1", "missing_vector"), ("old-2", "missing_vector"),
    ]
    sourced = chunks.withColumn("source", F.when(F.col("doc") == 1, "t1"))
    tables = spark.createDataFrame([("t1",), ("t2",)], "table_id string")
    assert rows(linked_documents(tables, sourced, "table_id", "source", "doc")) == [("t1", 1, 2)]


def test_chunk_list_scores(spark, chunks):
    out = list_chunks(chunks, " Beta ", "chunk_id").collect()
    assert [(r["chunk_id"], r["score"], r["total"]) for r in out] == [("old-1", 3, 2), ("old-2", 3, 2)]
    titled = chunks.withColumn("title", F.when(F.col("doc") == 1, "beta beta"))
    out = list_chunks(titled, "beta", "chunk_id", title_column="title").collect()
    assert out[0]["score"] == 2 * 3 + 3 * 2 + 1
    assert list_chunks(chunks, "  ", "chunk_id").count() == 3


def test_context_is_ordered_by_rank(spark, chunks):
    hits = spark.createDataFrame([(1, "old-2", 1, 0.5), (1, "old-1", 2, 0.4)], "query_id long, id string, rank int, score double")
    assert rows(retrieved_context(hits, chunks, "chunk_id")) == [(1, 2, "[1] (old-2)\nBeta\n\n---\n\n[2] (old-1)\nalpha beta")]
    titled = chunks.withColumn("title", F.when(F.col("chunk_index") == 1, "T").otherwise("")).withColumn("text", F.repeat("text", 400))
    brief = brief_context(hits, titled, "chunk_id", title="title").first()["context"]
    assert brief == "[K1] T\n" + ("Beta" * 300) + "\n\n[K2] old-1\n" + ("alpha beta" * 120)
    assert rows(hit_sources(hits, chunks, "chunk_id"), "rank", "title", "score", "preview") == [(1, "old-2", 0.5, "Beta"), (2, "old-1", 0.4, "alpha beta")]


def slow_kept(passages):
    kept = []
    for p in passages:
        for q in kept:
            short, long = sorted((p, q), key=len)
            if p and q and (p == q or (len(short) > 50 and short in long)):
                return len(kept)
        kept.append(p)
    return len(kept)


def test_repeats_against_all_pairs():
    random.seed(8)
    base = "".join(random.choice("ab ") for _ in range(240))
    for _ in range(400):
        passages = []
        for _ in range(random.randrange(1, 12)):
            start = random.randrange(0, 200)
            piece = base[start : start + random.choice([3, 50, 51, 52, 90, 200])]
            passages.append(piece if random.random() < 0.5 else piece + random.choice("xyz") * random.randrange(1, 60))
        assert _kept_passages(passages) == slow_kept(passages)


def test_repeated_sections_are_cut(spark):
    report = "# 1. Summary\n\nSales grew.\n\n## Details\n\nMore text.\n\n# 2. **Summary**\n\nAgain."
    copies = "one\n\ntwo\n\n  ONE \n\nthree"
    df = spark.createDataFrame([(1, report), (2, copies), (3, "plain"), (4, "")], "id long, text string")
    out = {r["id"]: (r["text"], r["paragraphs"], r["kept_paragraphs"]) for r in cut_repeats(df, "text").collect()}
    assert out[1][0] == "# 1. Summary\n\nSales grew.\n\n## Details\n\nMore text."
    assert out[2] == ("one\n\ntwo", 4, 2)
    assert out[3] == ("plain", 1, 1) and out[4] == ("", 0, 0)


def test_scores_lower_a_text_once(spark):
    """The filter on the score does not write the lowered text out for each of its uses, and columns keep their places."""
    chunks = spark.range(3).selectExpr("id AS chunk_id", "concat('The of ', id, ' the') AS text")
    found = chunk_scores(chunks, "The of")
    assert found._jdf.queryExecution().executedPlan().toString().count("lower(") == 1
    assert [tuple(r) for r in found.orderBy("chunk_id").collect()] == [(i, f"The of {i} the", 4) for i in range(3)]
    assert chunk_scores(chunks.selectExpr("chunk_id", "7 AS score", "text"), "The of").columns == ["chunk_id", "score", "text"]


def test_windows_cut_a_paragraph_up_once(spark):
    texts = spark.range(2).selectExpr("repeat(concat('a', id), 1000) AS text")
    cut = texts.select(chunk_bodies(F.col("text")).alias("bodies"))
    assert cut._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(") == 1
    assert [len(x) for x in cut.first()["bodies"]] == [900, 900, 440]
