import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tabulon.operators import lexical, vectors as vectors_module
from tabulon.operators.lexical import bm25
from tabulon.operators.vectors import embed, fuse_ranks, hybrid_search, vector_topk


def words(text):
    return [w for w in re.findall(r"\w+", text.lower()) if len(w) > 1]


def slow_bm25(documents, query, k):
    """Every document against one query: (id, title, text) in, (id, score) out."""
    asked, fields = words(query), {i: f"{title} {text}".strip() for i, title, text in documents}
    held = {i: words(f) for i, f in fields.items()}
    mean = max(sum(map(len, held.values())) / len(held), 1)
    scores = {}
    for i, title, _ in documents:
        counts, total = Counter(held[i]), 0.0
        for w in sorted(set(asked)):
            df = sum(w in h for h in held.values())
            if counts[w]:
                total += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * counts[w] * 2.5 / (
                    counts[w] + 1.5 * (0.25 + 0.75 * len(held[i]) / mean)
                )
        phrase = " ".join(asked)
        if phrase:
            total += 1.5 * (phrase in fields[i].lower()) + 2.0 * (phrase in title.lower())
        if total > 0:
            scores[i] = round(total, 6)
    return sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]


@pytest.fixture(scope="module")
def library(spark):
    random.seed(9)
    vocabulary = ["apple", "pear", "plum", "fig", "lime", "kiwi", "date", "pineapple", "a", "é"]
    documents = [
        (f"d{i}", random.choice(["", "apple pie", "Fig Lime"]), " ".join(random.choices(vocabulary, k=random.randrange(0, 30))))
        for i in range(60)
    ] + [(f"same{i}", "", "plum plum fig") for i in range(30)]
    queries = [(1, "Apple fig"), (2, "plum"), (3, "app"), (4, "?"), (5, "lime lime kiwi"), (6, "nothing here"), (7, "fig lime"), (8, "Apple fig")]
    return documents, queries


def frames(spark, library):
    documents, queries = library
    return (
        spark.createDataFrame(documents, "id string, title string, text string").repartition(5),
        spark.createDataFrame(queries, "q long, text string"),
    )


@pytest.mark.parametrize("block,first", [(4096, 4), (4, 1)])
def test_bm25_against_every_document(spark, library, monkeypatch, block, first):
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", block)
    monkeypatch.setattr(lexical, "FIRST_BLOCKS", first)
    monkeypatch.setattr(lexical, "MORE_BLOCKS", 3)
    monkeypatch.setattr(lexical, "BLOCKS_PER_SALT", block)
    documents, queries = library
    got = {}
    for r in bm25(*frames(spark, library), "id", "text", "q", "text", 5, ["title"]).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for q, text in queries:
        expected = slow_bm25(documents, text, 5)
        assert [h[0] for h in got.get(q, [])] == [h[0] for h in expected], text
        assert [h[1] for h in got.get(q, [])] == pytest.approx([h[1] for h in expected], abs=1.1e-6)


def test_title_counts_more_than_body(spark):
    items = spark.createDataFrame(
        [("body", "Notes", "the budget plan and other things"), ("title", "Budget plan", "numbers"), ("noise", "Cats", "dogs")],
        "id string, title string, text string",
    )
    asked = spark.createDataFrame([(1, "budget plan")], "q long, text string")
    hits = bm25(items, asked, "id", "text", "q", "text", titles=["title"])
    assert [r["id"] for r in hits.orderBy("rank").collect()] == ["title", "body"]
    only = bm25(items.filter("id = 'body'"), asked, "id", "text", "q", "text", titles=["title"])
    assert rows(only, "id", "rank") == [("body", 1)]


def test_list_fields_are_searched(spark):
    items = spark.createDataFrame([(1, "x", ["zebra"]), (2, "y", [])], "id long, text string, keys array<string>")
    asked = spark.createDataFrame([("q", "zebra")], "q string, text string")
    assert rows(bm25(items, asked, "id", "text", "q", "text", extra=["keys"]), "query_id", "id") == [("q", 1)]


def test_no_documents_or_queries(spark, library):
    documents, queries = frames(spark, library)
    assert bm25(documents.limit(0), queries, "id", "text", "q", "text").count() == 0
    assert bm25(documents, queries.limit(0), "id", "text", "q", "text").count() == 0


@pytest.mark.parametrize("size", [1 << 30, 0])
def test_phrases_of_every_length(spark, monkeypatch, size):
    """Phrases inside one word, over two words and over more, at the edges of words and across other signs."""
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", size)
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 2)
    texts = ["pineapple pie tin", "apple pies", "apple, pie", "apple  pie", "an apple a pie", "xapple piex now", "pie apple", "so pineapple pie tins", "ap", "ÄPFEL äp", "apple pie"]
    documents = [(i, t.title() if i % 2 else "", "" if i % 2 else t) for i, t in enumerate(texts)]
    queries = ["apple", "apple pie", "pple", "pineapple pie tin", "ap", "äp", "pie now", "apple pie now here", "le pi", "zz", "zz yy", "apple pie tin", "a pie"]
    items = spark.createDataFrame(documents, "id long, title string, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(queries)), "q long, text string")
    got = {}
    for r in bm25(items, asked, "id", "text", "q", "text", 20, ["title"]).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for q, text in enumerate(queries):
        expected = slow_bm25(documents, text, 20)
        assert [h[0] for h in got.get(q, [])] == [h[0] for h in expected], text
        assert [h[1] for h in got.get(q, [])] == pytest.approx([h[1] for h in expected], abs=1.1e-6)


def test_one_index_serves_any_number_of_queries(spark, monkeypatch, tmp_path):
    """Queries by the thousand read the index as often as one does, and most blocks of rare words are never read."""
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 20)
    monkeypatch.setattr(lexical, "FIRST_BLOCKS", 1)
    rng = random.Random(4)
    documents = [(i, " ".join(["common"] * rng.randrange(1, 4) + [f"w{rng.randrange(50)}"] * (1 + i % 5 * (i < 200)) + ["x%d" % i])) for i in range(2000)]
    lexical.index_documents(spark.createDataFrame(documents, "id long, text string").repartition(2), "id", "text").write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))

    def plans_of(n):
        plans, heard = [], []

        def kept(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return computed_once(df)

        monkeypatch.setattr(lexical, "computed_once", kept)
        asked = spark.range(n).select(F.col("id").alias("q"), F.concat(F.lit("common w"), F.col("id") % 50, F.lit(" x"), F.col("id") % 2000).alias("text"))
        found = lexical.search_index(index, asked, "q", "text", 1, report=lambda *seen: heard.append(seen))
        hits = found.groupBy("query_id").count().collect()
        assert len(hits) == n and all(h["count"] == 1 for h in hits)
        return sum(p.count("FileScan") for p in plans), heard[0], found

    computed_once = lexical.computed_once
    few, _, _ = plans_of(3)
    many, (pairs, seen), found = plans_of(4100)
    assert many == few and seen < 0.1 * pairs
    one = found.where("query_id = 77").first()
    assert [(one["id"], one["score"])] == [(i, pytest.approx(x, abs=1.1e-6)) for i, x in slow_bm25([(i, "", t) for i, t in documents], "common w27 x77", 1)]


def test_a_posting_is_sent_once_for_all_queries(spark, monkeypatch):
    """Not once for each query that holds its token; and a task scores a share of the queries of a block."""
    sent, block_hits = [], lexical._block_hits

    def kept(rows, *rest):
        sent.append({r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()})
        return block_hits(rows, *rest)

    monkeypatch.setattr(lexical, "_block_hits", kept)
    items = spark.createDataFrame([(i, f"apple pear w{i}") for i in range(40)], "id long, text string").coalesce(1)
    asked = spark.createDataFrame([(q, f"pear plum apple w{q}") for q in range(30)], "q long, text string")
    whole = bm25(items, asked, "id", "text", "q", "text", 3)
    assert {r["query_id"]: r["id"] for r in whole.where("rank = 1").collect()} == {q: q for q in range(30)}
    assert sent[0][0] == 90 and sent[0][2] == 32
    monkeypatch.setattr(lexical, "QUERIES_PER_TASK", 7)
    assert rows(bm25(items, asked, "id", "text", "q", "text", 3)) == rows(whole)


@pytest.mark.parametrize("full", [200_000, 3])
def test_vectors_against_all_pairs(spark, monkeypatch, full):
    """Also where each task gets a few vectors and a few queries of a cell only."""
    monkeypatch.setattr(vectors_module, "VECTORS_PER_TASK", full)
    monkeypatch.setattr(vectors_module, "QUERIES_PER_TASK", full)
    monkeypatch.setattr(vectors_module, "VECTORS_PER_CELL", 1)
    monkeypatch.setattr(vectors_module, "FIRST_CELLS", 1)
    monkeypatch.setattr(vectors_module, "MORE_CELLS", 3)
    rng = np.random.default_rng(10)
    held = rng.normal(size=(80, 6)).round(2)
    held[5] = held[6] = held[7]
    asked = np.vstack([rng.normal(size=(4, 6)), held[5], np.zeros(6)])
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(held)] + [(99, None)], "id long, v array<float>").repartition(6)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "q long, v array<double>")
    out = vector_topk(vectors, queries, "id", "v", "q", "v", 7)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    unit = held.astype(np.float32).astype(float)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    for q, v in enumerate(asked):
        near = np.round(unit @ (v / (np.linalg.norm(v) or 1)), 9)
        best = sorted(range(80), key=lambda i: (-near[i], i))[:7]
        assert [h[0] for h in got[q]] == best
        assert [h[1] for h in got[q]] == pytest.approx([max(near[i], 0) for i in best], abs=6e-5)
    assert got[4][0] == (5, 1.0)


def test_cells_spare_most_vectors_and_lose_no_hit(spark, monkeypatch):
    """Recall against brute force is 1; a third of all vectors is the same one; broken vectors are no hits."""
    monkeypatch.setattr(vectors_module, "VECTORS_PER_CELL", 1)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    held = np.vstack([centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.05, np.tile(centres[0], (1000, 1)), np.zeros((5, 16))])
    asked = centres + rng.normal(size=centres.shape) * 0.05
    odd = [[float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] * 16, [1.0], None]
    records = [(i, [float(x) for x in v]) for i, v in enumerate(held)] + [(9000 + i, v) for i, v in enumerate(odd)]
    vectors = spark.createDataFrame(records, "id long, v array<double>").repartition(4)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)] + [(99, odd[0]), (98, None)], "q long, v array<double>")
    heard = []
    got = {}
    for r in vector_topk(vectors, queries, "id", "v", "q", "v", 10, report=lambda *seen: heard.append(seen)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    unit = np.divide(held, np.linalg.norm(held, axis=1, keepdims=True), out=np.zeros_like(held), where=held.any(1, keepdims=True))
    for q, v in enumerate(asked):
        near = np.round(unit @ (v / np.linalg.norm(v)), 9)
        assert [got[q][j] for j in range(1, 11)] == sorted(range(len(held)), key=lambda i: (-near[i], i))[:10]
    assert set(got) == set(range(40))
    pairs, seen = heard[0]
    assert seen < 0.3 * pairs
    assert vector_topk(vectors.limit(0), queries, "id", "v", "q", "v", 3).count() == 0
    assert vector_topk(vectors, queries.limit(0), "id", "v", "q", "v", 3).count() == 0


def test_fusion_of_ranks(spark):
    schema = "query_id long, id string, score double, rank int"
    near = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], schema)
    lexical_hits = spark.createDataFrame([(1, "b", 5.0, 1), (1, "c", 4.0, 2), (2, "c", 1.0, 1)], schema)
    out = {(r["query_id"], r["id"]): (r["rank"], r["score"], r["vector_rank"], r["keyword_rank"]) for r in fuse_ranks(near, lexical_hits).collect()}
    assert out[(1, "b")] == (1, round(0.65 / 62 + 0.35 / 61, 6), 2, 1)
    assert out[(1, "a")] == (2, round(0.65 / 61, 6), 1, None)
    assert out[(1, "c")][0] == 3 and out[(2, "c")][0] == 1


def test_hybrid_with_own_vectors(spark):
    items = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "blue plum")], "id long, text string")
    asked = spark.createDataFrame([(7, "green pear")], "q long, text string")
    out = hybrid_search(embed(items, "text"), embed(asked, "text"), "id", "text", "embedding", "q", "text", "embedding", 2)
    assert out.orderBy("rank").first()["id"] == 2 and out.count() == 2


def test_hash_vectors_count_words(spark):
    texts = ["one two two", "", None, "Ünï two é", "x " * 50 + "yy zz"]
    got = {r["id"]: r["embedding"] for r in embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), "text").collect()}
    for i, text in enumerate(texts):
        want = [0.0] * 64
        for w in words(text or ""):
            code = zlib.crc32(w.encode())
            want[code % 64] += 1.0 if code & 0x80000000 else -1.0
        assert got[i] == want


def test_caller_encodes_in_batches(spark):
    def lengths(texts):
        assert len(texts) <= 4
        return [[float(len(t)), 1.0] for t in texts]

    items = spark.createDataFrame([(i, "x" * i) for i in range(10)] + [(10, None)], "id long, text string").coalesce(1)
    out = embed(items, "text", lengths, "v", batch=4)
    assert {r["id"]: r["v"][0] for r in out.collect()} == {**{i: float(i) for i in range(10)}, 10: 0.0}
