import corpus_pipeline
from tabulon.llm.ngram_join import similar_documents
from tabulon.llm.op8 import op8_decontamination
from tabulon.llm.secrets import redacted, scan

FOLDER = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_join", "decontamination", "secrets", "packing"]
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, FOLDER)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    groups = {}
    for r in similar_documents(docs).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert ids(stages["ngram_join"](spark, docs, FOLDER)) == sorted(min(g) for g in groups.values())
    clean = sorted(r["doc_id"] for r in op8_decontamination(spark, FOLDER).where("not contaminated").collect())
    assert ids(stages["decontamination"](spark, docs, FOLDER)) == clean
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in stages["secrets"](spark, docs, FOLDER).collect():
        assert r["text"] == redacted(texts[r["doc_id"]], scan(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])


def one_of_each_group(rows):
    """Brute force: rows with words are linked by the likeness of their shingles; the smallest id stays."""
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group = [group[i] if g == group[j] else g for g in group]
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"])):
        first.setdefault(group[i], i)
    return [r for i, r in enumerate(rows) if not sets[i] or first[group[i]] == i]


def test_stages_on_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "same text here it is", "en", "s", 3), (2, "same text here it is", "en", "s", 3), (None, "x", None, None, 1)],
        docs.schema,
    )
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, odd, FOLDER).collect()
    assert sorted(map(str, kept)) == sorted(map(str, one_of_each_group(odd.collect())))
    assert corpus_pipeline.drop_contaminated(spark, odd, FOLDER).count() == 5
    assert corpus_pipeline.drop_toxic(spark, odd, FOLDER).count() == 5


def test_run_packs_what_is_left(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 100
