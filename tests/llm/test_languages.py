import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.errors import InvalidRequest
from tabulon.llm import languages
from tabulon.llm.languages import Words, best_paths, held_out, label_languages, learn_languages
from tabulon.llm.op13 import op13_language_id

FOLDER = "/root/testdata/sf0.01"
SYLLABLES = {"aa": "ba be bi bo bu da de", "bb": "kri kro kru stra stro", "cc": "лю бо ви на ро", "dd": "шча жы йо ёж цы"}


def words(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(i, words(lang, 60, i), lang, "s") for i, lang in enumerate(sorted(SYLLABLES) * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row string")


def label(spark, model, texts, **options):
    rows = [(i, t, None) for i, t in enumerate(texts)]
    found = label_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, **options)
    return [r.asDict(recursive=True) for r in found.orderBy("doc_id").collect()]


def test_paths_are_the_best_ones():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(0, 6, 5)
        first = np.cumsum(sizes) - sizes
        scores = rng.integers(-6, 1, (sizes.sum(), 3)).astype(np.int64)
        labels = best_paths(scores, first, sizes, 4)
        for a, n in zip(first, sizes):
            def worth(path):
                return sum(scores[a + i, s] for i, s in enumerate(path)) - 4 * sum(x != y for x, y in zip(path, path[1:]))
            if n:
                assert worth(labels[a : a + n]) == max(map(worth, itertools.product(range(3), repeat=int(n))))


def test_words_are_runs_of_one_script():
    found = Words.of(["Ab1c жЖ́b", None, "", "́é 日本ab", "İx"])
    texts = ["Ab1c жЖ́b", "", "", "́é 日本ab", "İx"]
    got = [(int(t), texts[t][a - found.offsets[t] : b - found.offsets[t]]) for t, a, b in zip(found.text, found.starts, found.ends)]
    assert got == [(0, "Ab"), (0, "c"), (0, "жЖ́"), (0, "b"), (3, "é"), (3, "日本"), (3, "ab"), (4, "İx")]
    assert [chr(c) for c in found.letters[:2]] == ["a", "b"]


def test_spans_of_mixed_text(spark, taught):
    model = learn_languages(taught)
    assert model.languages == tuple(SYLLABLES)
    parts = [words("aa", 30, "x"), words("cc", 20, "x"), words("bb", 30, "y"), words("dd", 40, "x")]
    text = ". 12 ".join(parts)
    got = label(spark, model, [text, parts[2] + " люк " + parts[2]])
    assert [s["lang"] for s in got[0]["spans"]] == ["aa", "cc", "bb", "dd"]
    for span, part in zip(got[0]["spans"], parts):
        assert abs(span["start"] - text.index(part)) < 40 and abs(span["end"] - text.index(part) - len(part)) < 40
    sizes = {s["lang"]: sum(c.isalpha() for c in text[s["start"] : s["end"]]) for s in got[0]["spans"]}
    assert got[0]["lang_pred"] == max(sizes, key=sizes.get)
    assert 0 < got[0]["score"] < 0.6 < got[1]["score"] <= 1 and got[1]["lang_pred"] == "bb"


def test_scripts_narrow_candidates(spark, taught):
    """A word of a script counts for its languages only, whatever its letters; unknown scripts leave all of them."""
    got = label(spark, learn_languages(taught), ["ъъъ ыыы", "日本", "qqq", "Ж"])
    assert got[0]["lang_pred"] in ("cc", "dd") and got[2]["lang_pred"] in ("aa", "bb") and got[3]["lang_pred"] == "dd"
    assert got[1]["lang_pred"] in SYLLABLES


def test_odd_texts(spark, taught):
    model = learn_languages(taught)
    long = words("bb", 60_000, "long")
    got = label(spark, model, [None, "", "12 34 !?", "́", "ba", "ba", long])
    assert [g["lang_pred"] for g in got] == ["und"] * 4 + ["aa", "aa", "bb"]
    assert [g["score"] for g in got[:4]] == [0.0] * 4 and got[4]["score"] == got[5]["score"]
    assert got[6]["spans"] == [{"start": 0, "end": len(long), "lang": "bb"}]
    whole = label_languages(taught, model, whole_rows=True)
    assert whole.select("row.*").columns == taught.columns
    assert label_languages(taught.limit(0), model).count() == 0


def test_little_or_nothing_to_learn(spark, taught, monkeypatch):
    nothing = taught.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    model = learn_languages(nothing)
    assert model.languages == () and label(spark, model, ["ba be"])[0]["lang_pred"] == "und"
    blank = spark.createDataFrame([(0, "", "aa"), (None, "x", "bb"), (1, None, "cc")], "doc_id long, text string, lang string")
    assert learn_languages(blank).languages == ("aa",)
    assert label(spark, learn_languages(blank), ["ba be"])[0]["lang_pred"] == "aa"
    one = learn_languages(taught.where("lang = 'aa'"))
    assert label(spark, one, ["kri kro", "1"])[0]["lang_pred"] == "aa"
    monkeypatch.setattr(languages, "MAX_LANGUAGES", 3)
    with pytest.raises(InvalidRequest):
        learn_languages(taught)


def test_the_same_for_any_partitions(spark, taught):
    a, b = learn_languages(taught.repartition(1)), learn_languages(taught.repartition(7))
    assert (a.weights == b.weights).all() and (a.uses == b.uses).all()
    one, two = (label_languages(taught.repartition(n), a).select("doc_id", "lang_pred", "score", "spans") for n in (1, 6))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = op13_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id")
    sums = found.where("held_out").agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert sums["n"] > 150 and sums["right"] >= 0.97 * sums["n"]
    assert found.count() == docs.count() and found.where("score < 0 or score > 1").isEmpty()
    assert found.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).isEmpty()
    without = learn_languages(docs.where(~held_out()))
    assert (without.weights == learn_languages(docs).weights).all()
