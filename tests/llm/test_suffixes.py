import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import suffixes
from tabulon.llm.suffixes import remove_repeated_strings, told_apart

SCHEMA = "doc_id long, text string, owner int, key string"


def test_expansion_tells_suffixes_apart():
    rng = random.Random(5)
    for _ in range(200):
        least, letters = rng.choice([1, 2, 3, 5, 8, 9, 13, 20, 30, 200]), rng.choice([1, 2, 3, 26, 256])
        text = bytes(rng.randrange(letters) for _ in range(rng.randint(0, 300)))
        if rng.random() < 0.7:
            text = (text + text[: len(text) // 2] * rng.randint(1, 4) + text)[:1200]
        order, apart = told_apart(np.frombuffer(text, np.uint8), least)
        begins = [text[i : i + least] for i in order]
        assert sorted(order.tolist()) == list(range(len(text) + 1)) and begins == sorted(begins)
        assert apart.tolist() == [True] + [a != b for a, b in zip(begins, begins[1:])]


def expected(rows, least):
    docs = [(t or "").encode() for _, t in rows]
    counts = Counter(d[i : i + least] for d in docs for i in range(len(d) - least + 1))
    out = []
    for (doc, _), data in zip(rows, docs):
        gone = [False] * len(data)
        for i in range(len(data) - least + 1):
            if counts[data[i : i + least]] > 1:
                gone[i : i + least] = [True] * least
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh \n", "abcdefghijklmnopqrstuvwxyzéß日"])
@pytest.mark.parametrize("least, anchor, sizes", [(200, 40, {}), (20, 5, {}), (20, 5, {"text_bytes": 100, "group_bytes": 100})])
def test_agrees_with_brute_force(spark, letters, least, anchor, sizes):
    rng = random.Random(len(letters))
    pool = ["".join(rng.choices(letters, k=rng.choice([20, 25, 40, 199, 200, 201, 230, 400, 900]))) for _ in range(8)]
    pool += ["a" * 300, "ab" * 200]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                piece = rng.choice(pool)
                text += piece[rng.randint(0, 5) : len(piece) - rng.randint(0, 5)]
            else:
                text += "".join(rng.choices(letters, k=rng.randint(0, 300)))
        rows.append((rng.choice([i, i, i, 7, None]), text))
    rows += [(900, rows[3][1])] * 2 + [(901, None), (902, ""), (903, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    found = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in remove_repeated_strings(df, least, anchor, **sizes).collect()]
    assert sorted(found, key=str) == expected(rows, least)


def test_empty_table(spark):
    assert remove_repeated_strings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_a_settled_block_are_compared_once(monkeypatch):
    """Strings of an open block are found in a settled one, of which one copy is looked at."""
    seen, repeated = [], suffixes.repeated_strings
    monkeypatch.setattr(suffixes, "repeated_strings", lambda blocks, least: seen.append(len(blocks)) or repeated(blocks, least))
    settled, open_ = bytes(range(60, 75)), bytes(range(62, 77))
    rows = [(1, who, 5, 6, settled, True) for who in range(50)] + [(1, 99, 6, 6, open_, False)]
    names = ["anchor", "owner", "name", "count", "bytes", "whole"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    (told,) = suffixes._compared(10, 1 << 17, 4 << 20)(iter([batch]))
    assert seen == [2]
    assert [(r["owner"], r["key"] >> 32, r["key"] & 0xFFFFFFFF) for r in told.to_pylist()] == [(99, 0, 4)]
