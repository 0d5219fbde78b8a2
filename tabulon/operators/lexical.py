"""BM25 ranking for a batch of queries by a postings index, and the simple score of a chunk list."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabulon.functions.rounding import half_up_array
from tabulon.functions.schema import col, require_columns
from tabulon.functions.text import occurrences, tokens
from tabulon.operators.topk import merge_hits
from tabulon.session import computed_once, scratch_path

# BM25 constants and the bonuses for a literal match.
K1, B = 1.5, 0.75
PHRASE_BONUS, TITLE_BONUS = 1.5, 2.0
SCORE_DIGITS = 6
#: Documents of a block, and blocks of a query that are read before any is ruled out.
BLOCK_DOCUMENTS = 4096
FIRST_BLOCKS = 8
MORE_BLOCKS = 64  # times as many in each further round, which moves the postings of the blocks it reads
BLOCKS_PER_SALT = 256
#: Queries of a block that one task scores.
QUERIES_PER_TASK = 512
#: Tables that are computed anyway are broadcast up to this size; beyond it the planner joins them as it sees fit.
BROADCAST_BYTES = 64 << 20


def joined_fields(df: DataFrame, names: Sequence[str]) -> Column:
    """Text fields joined by blanks, empty ones left out; a list field gives all its entries."""
    parts = []
    for n in names:
        if isinstance(df.schema[n].dataType, T.ArrayType):
            parts.append(F.array_join(col(n).cast("array<string>"), " "))
        else:
            parts.append(col(n).cast("string"))
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ")


# --- the index --------------------------------------------------------------------------


def _frontier(token: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows that no other row of the same token beats with a higher count in a shorter document. Whatever the mean length
    of all documents is, the largest weight of a token in a block is that of one of these."""
    order = np.lexsort((-tf, length, token))
    wide = int(tf.max()) + 1
    level = token[order].astype(np.int64) * wide + tf[order]
    best = np.concatenate([[-1], np.maximum.accumulate(level)[:-1]])
    return order[level > best]


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def _blocks(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of documents, each with its postings: a token's documents, counts and lengths lie in one row."""

    def rows(count: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(count, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_DOCUMENTS):
                part = whole.slice(at, BLOCK_DOCUMENTS)
                # In a block documents are numbered by id, so that ties are settled before ids are looked up.
                part = part.take(pc.sort_indices(part.column("id"), null_placement="at_start"))
                n, lists = part.num_rows, part.column("tokens")
                lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                block = pa.array(np.full(n, number), pa.int64())
                yield rows(
                    n, block=block, doc=pa.array(np.arange(n), pa.int32()), length=pa.array(lengths, pa.int32()),
                    **{c: part.column(c) for c in ("id", "searchable", "title")},
                )
                words = lists.flatten().dictionary_encode()
                if len(words):
                    of = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                    pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + of, return_counts=True)
                    token, doc = pair // n, pair % n
                    tokens_ = np.arange(len(words.dictionary))
                    starts = np.append(np.searchsorted(token, tokens_), len(token))
                    top = _frontier(token, tf, lengths[doc])
                    top_starts = np.append(np.searchsorted(token[top], tokens_), len(top))
                    yield rows(
                        len(tokens_), block=pa.array(np.full(len(tokens_), number), pa.int64()), token=words.dictionary,
                        n=pa.array(np.diff(starts), pa.int32()), docs=_lists(starts, doc), tf=_lists(starts, tf), lengths=_lists(starts, lengths[doc]),
                        top_tf=_lists(top_starts, tf[top]), top_lengths=_lists(top_starts, lengths[doc][top]),
                    )
                number += 1

    return run


def index_documents(
    documents: DataFrame,
    id_column: str,
    text_column: str,
    titles: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """What a search reads: postings (rows with a token) and documents (rows without), both by block.

    A block is some thousand documents of one task, so indexing shuffles nothing. A posting holds a token's documents in
    one block with counts and lengths, and those counts and lengths that may be the largest weight. To be written once
    as a table; a search reads it several times and needs the same blocks each time.
    """
    require_columns(documents, [id_column, text_column, *titles, *extra])
    searchable = joined_fields(documents, [*titles, text_column, *extra])
    title = F.lower(joined_fields(documents, titles)) if titles else F.lit("")
    source = documents.select(
        col(id_column).alias("id"), tokens(searchable).alias("tokens"),
        F.lower(searchable).alias("searchable"), title.alias("title"),
    )
    ints = T.ArrayType(T.IntegerType())
    fields = {
        "block": T.LongType(), "token": T.StringType(), "n": T.IntegerType(), "docs": ints, "tf": ints, "lengths": ints,
        "top_tf": ints, "top_lengths": ints, "doc": T.IntegerType(), "length": T.IntegerType(), "id": source.schema["id"].dataType,
        "searchable": T.StringType(), "title": T.StringType(),
    }
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    return source.mapInArrow(_blocks(arrow), schema)


# --- phrases ----------------------------------------------------------------------------


def _expanded(vocabulary: DataFrame, parts: DataFrame) -> DataFrame:
    """(q, side, token): tokens that hold, begin or end with a part of a short query. Parts: ``q``, ``part`` and ``side`` (``in``,
    ``start``, ``end``). Both meet on two or three characters and are compared in full."""
    width = F.length("token")
    inner = F.transform(F.sequence(F.lit(1), width - 1), lambda i: F.struct(F.lit("in").alias("side"), F.substring(F.col("token"), i, F.lit(2)).alias("gram")))
    longer = F.when(width > 2, F.transform(F.sequence(F.lit(1), width - 2), lambda i: F.struct(F.lit("in").alias("side"), F.substring(F.col("token"), i, F.lit(3)).alias("gram"))))
    edges = []
    for k in (2, 3):
        edges.append(F.when(width >= k, F.struct(F.lit("start").alias("side"), F.substring("token", 1, k).alias("gram"))))
        edges.append(F.when(width >= k, F.struct(F.lit("end").alias("side"), F.substring(F.col("token"), width - k + 1, F.lit(k)).alias("gram"))))
    grams = F.array_distinct(F.concat(inner, F.coalesce(longer, F.array().cast("array<struct<side: string, gram: string>>")), F.array_compact(F.array(*edges))))
    spelled = vocabulary.select("token", F.inline(grams))
    size = F.least(F.length("part"), F.lit(3))
    gram = F.when(F.col("side") == "end", F.substring(F.col("part"), F.length("part") - size + 1, size)).otherwise(F.substring(F.col("part"), F.lit(1), size))
    fits = F.when(F.col("side") == "in", F.contains("token", "part")).when(F.col("side") == "start", F.startswith("token", "part")).otherwise(F.endswith("token", "part"))
    return parts.withColumn("gram", gram).join(spelled, ["side", "gram"]).where(fits).select("q", "side", "token")


def _phrase_hits(index: DataFrame, asked: DataFrame, frequency: DataFrame) -> DataFrame:
    """(q, block, doc, bonus) where a document holds the tokens of a query, joined by blanks.

    Inner tokens of such a phrase are tokens of the document, its first one ends and its last one begins one. So the
    documents of one of these, the rarest, are candidates; their texts decide.
    """
    postings, n = index.where("token is not null"), F.size("tokens")
    inner = asked.where(n > 2).select("q", F.explode(F.array_distinct(F.slice("tokens", F.lit(2), n - 2))).alias("token"))
    counted = inner.join(frequency.select("token", "df"), "token", "left").groupBy("q")
    rarest = counted.agg(F.min_by("token", "df").alias("token"), F.min(F.coalesce("df", F.lit(0))).alias("least"))
    wanted = rarest.where("least > 0").select("q", "token")
    short = asked.where(n <= 2)
    if not short.isEmpty():
        vocabulary = postings.groupBy("token").agg(F.sum("n").alias("df"))
        one = short.where(n == 1).select("q", F.col("tokens")[0].alias("part"), F.lit("in").alias("side"))
        two = short.where(n == 2).select("q", F.inline(F.array(
            F.struct(F.col("tokens")[0].alias("part"), F.lit("end").alias("side")), F.struct(F.col("tokens")[1].alias("part"), F.lit("start").alias("side")),
        )))
        found = computed_once(_expanded(vocabulary.select("token"), one.unionByName(two)).join(vocabulary, "token"))
        sides = found.groupBy("q", "side").agg(F.sum("df").alias("df"))
        sides = sides.groupBy("q").agg(F.min_by("side", "df").alias("side"), F.count(F.lit(1)).alias("sides"))
        whole = sides.join(short.select("q", n.alias("n")), "q").where(F.col("sides") == F.col("n")).select("q", "side")
        wanted = wanted.unionByName(found.join(whole, ["q", "side"]).select("q", "token"))
    near = postings.select("token", "block", "docs").join(_side(computed_once(wanted)), "token")
    candidates = computed_once(near.select("q", "block", F.explode("docs").alias("doc")).distinct())
    phrase = asked.select("q", F.array_join("tokens", " ").alias("phrase"))
    texts = index.where("token is null").select("block", "doc", "searchable", "title")
    bonus = F.lit(PHRASE_BONUS) + F.when(F.contains("title", "phrase"), TITLE_BONUS).otherwise(0.0)
    return texts.join(_side(candidates), ["block", "doc"]).join(_side(computed_once(phrase)), "q").where(F.contains("searchable", "phrase")).select("q", "block", "doc", bonus.alias("bonus"))


# --- the search -------------------------------------------------------------------------


def _block_hits(rows: DataFrame, mean_length: float, k: int) -> DataFrame:
    """(q, block, doc, score): the ``k`` best documents of every pair of query and block.

    The rows of a block come to one task, each posting once however many queries hold its token: first the tokens of the queries
    (``q, token, idf``), then the documents with a bonus (``q, docs, bonus``), then the postings (``token, docs, tf, lengths``). Held are a
    batch and the scores of one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, queries, wanted, scores = None, [], None, {}, None

        def ready() -> None:
            """Scores of nothing yet, one row per query, once all its tokens are known."""
            nonlocal queries, wanted, scores
            q, token, idf = (np.concatenate(x) for x in zip(*asked))
            queries, row = np.unique(q, return_inverse=True)
            order = np.argsort(token, kind="stable")
            token, row, idf = token[order], row[order], idf[order]
            names, starts = np.unique(token, return_index=True)
            ends = np.append(starts[1:], len(token))
            wanted = {t: (row[a:b].tolist(), idf[a:b].tolist()) for t, a, b in zip(names.tolist(), starts.tolist(), ends.tolist())}
            scores = np.zeros((len(queries), BLOCK_DOCUMENTS))

        def add(row: int, docs: np.ndarray, weight: np.ndarray | float) -> None:
            nonlocal scores
            if docs[-1] >= scores.shape[1]:
                scores = np.pad(scores, ((0, 0), (0, int(docs[-1]) + 1 - scores.shape[1])))
            scores[row, docs] += weight

        def best() -> pa.RecordBatch:
            found = []
            for row, all_ in enumerate(half_up_array(scores, SCORE_DIGITS)):
                docs = np.flatnonzero(all_ > 0)
                if len(docs) > k:
                    docs = docs[all_[docs] >= np.partition(all_[docs], len(docs) - k)[len(docs) - k]]
                    docs = docs[np.argsort(-all_[docs], kind="stable")[:k]]
                found.append((np.full(len(docs), queries[row]), docs, all_[docs]))
            q, doc, score = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(np.full(len(q), at[0]), pa.int64()), pa.array(doc, pa.int32()), pa.array(score)], names=["q", "block", "doc", "score"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("block", "share", "kind")])
            cuts = np.append(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])), len(keys))
            for a, b in zip(cuts, cuts[1:]):
                part, here, kind = batch.slice(a, b - a), tuple(keys[a][:2].tolist()), keys[a][2]
                if here != at:
                    if scores is not None:
                        yield best()
                    at, asked, scores = here, [], None
                if kind == 0:
                    asked.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("q", "token", "idf")))
                    continue
                if not asked:
                    continue
                if scores is None:
                    ready()
                lists = part.column("docs")
                docs = lists.flatten().to_numpy()
                ends = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
                starts = [0, *ends]
                if kind == 1:
                    for row, bonus, x, y in zip(np.searchsorted(queries, part.column("q").to_numpy(zero_copy_only=False)).tolist(), part.column("bonus").to_pylist(), starts, ends):
                        add(row, docs[x:y], bonus)
                    continue
                tf = part.column("tf").flatten().to_numpy().astype(np.float64)
                base = tf + K1 * (1 - B + B * part.column("lengths").flatten().to_numpy() / mean_length)
                for token, x, y in zip(part.column("token").to_pylist(), starts, ends):
                    for row, idf in zip(*wanted.get(token, ((), ()))):
                        add(row, docs[x:y], idf * tf[x:y] * (K1 + 1) / base[x:y])
        if scores is not None:
            yield best()

    key = ["block", "share"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "kind", "token")
    return dealt.mapInArrow(run, "q long, block long, doc int, score double")


def _side(df: DataFrame) -> DataFrame:
    """A computed table for a join: sent to all tasks where it was measured to be small."""
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType) else F.lit(0)) + 16 for f in df.schema.fields)
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _scored(pairs: DataFrame, weights: DataFrame, postings: DataFrame, phrases: DataFrame, mean_length: float, k: int) -> DataFrame:
    """The hits of some pairs of query and block. Where very many queries read a block, its postings are sent to each share of them."""
    # One row per block.
    shares = F.broadcast(pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES_PER_TASK)).cast("int").alias("shares")))
    shared = pairs.select("q", "block").join(shares, "block").select("q", "block", F.pmod(F.xxhash64("q"), F.col("shares")).cast("int").alias("share"))
    long, double, ints = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("array<int>")
    asked = shared.join(weights.select("q", "number", "idf"), "q").select(
        "block", "share", F.lit(0).alias("kind"), F.col("number").alias("token"), "q", "idf", double.alias("bonus"), ints.alias("docs"), ints.alias("tf"), ints.alias("lengths")
    )
    # A query whose tokens no document holds has no number of any; its phrase may lie inside a longer word.
    alone = shared.join(phrases.select("q").distinct(), "q", "left_semi").select(
        "block", "share", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("token"), "q", F.lit(0.0).alias("idf"), double.alias("bonus"), ints.alias("docs"), ints.alias("tf"), ints.alias("lengths")
    )
    marked = phrases.join(shared, ["q", "block"]).groupBy("q", "block", "share", "bonus").agg(F.sort_array(F.collect_list("doc")).alias("docs")).select(
        "block", "share", F.lit(1).alias("kind"), long.alias("token"), "q", double.alias("idf"), "bonus", "docs", ints.alias("tf"), ints.alias("lengths")
    )
    held = postings.join(shares, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(2).alias("kind"), F.col("number").alias("token"), long.alias("q"),
        double.alias("idf"), double.alias("bonus"), "docs", "tf", "lengths",
    )
    return computed_once(_block_hits(asked.unionByName(alone).unionByName(marked).unionByName(held), mean_length, k))


def search_index(
    index: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int = 8, report: Callable[[int, int], None] | None = None
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best documents of every query.

    The tokens of all queries are joined to the postings. From the largest weights of its tokens in a block follows the
    most that a document there can score. Each query reads its most promising blocks first; of the others, in a few rounds, only
    those that may still hold one of the ``k`` best, or that hold its phrase. No query passes the driver, and the index is read
    the same few times for any number of them. ``report`` hears how many (query, block) pairs there are and how many were read.
    """
    require_columns(queries, [query_id, query_text])
    spark = index.sparkSession
    asked = queries.select(col(query_id).alias("query_id"), tokens(col(query_text)).alias("tokens")).where(F.size("tokens") > 0)
    asked = computed_once(asked.withColumn("q", F.monotonically_increasing_id()))
    documents = index.where("token is null")
    size = documents.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("length").cast("long")).alias("length")).first()
    if not size["n"]:
        schema = T.StructType([asked.schema["query_id"], index.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return spark.createDataFrame([], schema)
    mean_length = max(size["length"] / size["n"], 1.0)
    each = asked.select("q", F.explode(F.array_distinct("tokens")).alias("token"))
    part = F.zip_with("top_tf", "top_lengths", lambda t, n: t * (K1 + 1) / (t + K1 * (1 - B + B * n / mean_length)))
    light = index.where("token is not null").select("token", "block", "n", F.array_max(part).alias("most"))
    light = computed_once(light.join(_side(computed_once(each.select("token").distinct())), "token", "left_semi"))
    df = F.sum(F.col("n").cast("long"))
    frequency = light.groupBy("token").agg(df.alias("df"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCKS_PER_SALT)).cast("int").alias("salts"))
    idf = F.log(1 + (F.lit(float(size["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    frequency = computed_once(frequency.withColumn("idf", idf).withColumn("number", F.monotonically_increasing_id()))
    weights = computed_once(each.join(frequency, "token"))
    # A token in many blocks is dealt out by block, and the queries that hold it are sent to each part.
    salted = light.join(frequency.select("token", "salts"), "token").withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int"))
    sent = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("q", "token", "salt", "idf")
    phrases = computed_once(_phrase_hits(index, asked, frequency))
    bounds = salted.join(sent, ["token", "salt"]).select("q", "block", (F.col("idf") * F.col("most")).alias("bound"), F.lit(False).alias("phrase"))
    marked = phrases.select("q", "block", F.lit(0.0).alias("bound"), F.lit(True).alias("phrase")).distinct()
    pairs = bounds.unionByName(marked).groupBy("q", "block").agg(F.sum("bound").alias("bound"), F.max("phrase").alias("phrase"))
    promising = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    pairs = computed_once(pairs.withColumn("nth", F.row_number().over(promising)))
    best, upto = Window.partitionBy("q").orderBy(F.desc("score")), FIRST_BLOCKS
    postings = index.where("token is not null").select("token", "block", "docs", "tf", "lengths").join(_side(frequency.select("token", "number")), "token")
    hits = _scored(pairs.where(F.col("nth") <= upto), weights, postings, phrases, mean_length, k)
    seen, left = [pairs.where(F.col("nth") <= upto)], pairs.where(F.col("nth") > upto)
    while True:
        floor = hits.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("q", F.col("score").alias("floor"))
        reach = F.col("floor").isNull() | F.col("phrase") | (F.col("bound") >= F.col("floor") - 2 * 10.0**-SCORE_DIGITS)
        left = computed_once(left.join(floor, "q", "left").where(reach).drop("floor"))
        if left.isEmpty():
            break
        upto *= MORE_BLOCKS
        seen.append(left.where(F.col("nth") <= upto))
        hits = hits.unionByName(_scored(seen[-1], weights, postings, phrases, mean_length, k))
        left = left.where(F.col("nth") > upto)
    if report is not None:
        report(pairs.count(), sum(s.count() for s in seen))
    hits = computed_once(hits.withColumn("at", F.rank().over(best)).where(F.col("at") <= k).drop("at"))  # ties are settled by id
    named = documents.select("block", "doc", "id").join(_side(hits), ["block", "doc"]).join(asked.select("q", "query_id"), "q")
    return merge_hits(named.select("query_id", "id", "score"), k)


def bm25(
    documents: DataFrame,
    queries: DataFrame,
    id_column: str,
    text_column: str,
    query_id: str,
    query_text: str,
    k: int = 8,
    titles: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """``search_index`` over documents that are not indexed yet: the index is written once, below the checkpoint folder."""
    path = scratch_path(documents.sparkSession, "index")
    index = index_documents(documents, id_column, text_column, titles, extra)
    index.write.parquet(path)
    return search_index(documents.sparkSession.read.schema(index.schema).parquet(path), queries, query_id, query_text, k)


def chunk_scores(
    chunks: DataFrame,
    query: str,
    text_column: str = "text",
    title_column: str | None = None,
    section_column: str | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Chunks that match a query, with a plain score: literal occurrences, title and section
    occurrences, and one point per word of the query that occurs."""
    wanted = query.lower().strip()
    if not wanted:
        return chunks.withColumn("score", F.lit(0).cast("long"))

    def lowered(name: str | None) -> Column:
        return F.lit("") if name is None else F.lower(F.coalesce(col(name).cast("string"), F.lit("")))

    text, title, section = lowered(text_column), lowered(title_column), lowered(section_column)
    rest = [joined_fields(chunks, [e]) for e in extra]
    haystack = F.concat_ws(" ", text, title, section, *rest)
    needle = F.lit(wanted)

    def points(x: Column) -> Column:
        score = 2 * occurrences(x["haystack"], needle)
        score = score + 3 * occurrences(x["title"], needle) + 2 * occurrences(x["section"], needle)
        for word in (w for w in re.findall(r"\w+", wanted) if len(w) > 1):
            score = score + x["haystack"].contains(word).cast("long")
        return score

    # An exploded entry is computed once a row; a plain column the planner would write out again for the filter, and the
    # lowered text for each of its uses.
    fields = F.struct(haystack.alias("haystack"), title.alias("title"), section.alias("section"))
    score = F.transform(F.array(fields), lambda x: points(x).cast("long"))
    names = ["score" if c.lower() == "score" else c for c in chunks.columns]
    scored = chunks.select(*[col(c) for c in names if c != "score"], F.explode(score).alias("score"))
    return scored.select(*map(col, dict.fromkeys([*names, "score"]))).filter(F.col("score") > 0)


def list_chunks(
    chunks: DataFrame, query: str, id_column: str, limit: int = 50, offset: int = 0, **fields
) -> DataFrame:
    """One page of the scored list, with the number of all matches."""
    found = chunk_scores(chunks, query, **fields)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        found.orderBy(F.desc("score"), col(id_column)).offset(offset).limit(limit).withColumn("total", total)
    )
