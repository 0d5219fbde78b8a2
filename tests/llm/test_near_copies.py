"""The n-gram join stage keeps one row of each group, whatever its ids: against plain Python."""

import random
from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def grams(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def expected(rows):
    """Ids that may stay in each group, and the rows without words."""
    sets, group = [grams(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    members = {}
    for row, own, g in zip(rows, sets, group):
        if own:
            members.setdefault(g, []).append(row)
    return list(members.values()), [r for r, own in zip(rows, sets) if not own]


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    left = Counter(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    groups, empty = expected(rows)
    assert sum(left.values()) == len(groups) + len(empty)
    for members in groups:
        stays = [r for r in set(members) for _ in range(left[r])]
        ids = [r[0] for r in members if r[0] is not None]
        assert len(stays) == 1 and stays[0][0] == (min(ids) if ids else None)
    assert all(left[r] == n for r, n in Counter(empty).items())


def test_repeated_and_null_ids(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    bases = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    rows = [(1, "", "en", "s", 0), (1, "same text here it is", "en", "s", 3), (2, "same text here it is", "en", "s", 3)]
    for _ in range(90):
        text = rng.choice([*bases, "", None, " \n", "x"])
        if text in bases and rng.random() < 0.5:
            text += " " + rng.choice(words)
        rows.append((rng.choice([None, 1, 2, 3, 4, 50]), text, rng.choice(["en", None]), "s", rng.choice([1, 2])))
    rows += rows[5:40]
    check(spark, rows)


def test_odd_rows_one_by_one(spark):
    text = "same text here it is"
    check(spark, [(None, None, None, None, None), (1, "", "en", "s", 0), (1, text, "en", "s", 3), (2, text, "en", "s", 3), (None, "x", None, None, 1)])
    check(spark, [(None, text, "en", "s", 3)] * 3 + [(None, "", "en", "s", 3)] * 2)
