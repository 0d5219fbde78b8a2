import random

import pytest

from tabulon.llm.repeats import remove_repeats

LAST = (1 << 63) - 1
SCHEMA = "doc_id long, text string, owner int, key string"


def expected(rows, window):
    docs = [(LAST if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for doc, words in docs:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, words), (given, _) in zip(docs, rows):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((given, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size, window, rounds", [(3, 13, 14), (12, 13, 3), (400, 13, 14), (400, 5, 6), (12, 20, 9)])
def test_agrees_with_brute_force(spark, size, window, rounds):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(size)] + ["é\xa0y"]
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice([13, 14, 20, 40, 200]))] for _ in range(6)]
    pool += [["a"] * 50, ["a", "b"] * 30, ["a"] * 14]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(pool) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([i, i, i, 7, None]), " ".join(words[rng.randint(0, 3) :])))
    rows += [(900, rows[3][1])] * 2 + [(901, None), (902, "")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    assert sorted([tuple(r) for r in remove_repeats(df, window, rounds).collect()], key=str) == expected(rows, window)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
