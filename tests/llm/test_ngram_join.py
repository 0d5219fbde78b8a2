import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import ngram_join
from tabulon.llm.components import components
from tabulon.llm.ngram_join import linked_pairs, similar_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, name string, component int"


def grams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(pairs, n):
    lead = list(range(n))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        lead[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def all_links(sets):
    return [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]


def expected(rows):
    sets = [grams(text) for _, text in rows]
    group = groups(all_links(sets), len(rows))
    least = {}
    for g, (doc, _) in zip(group, rows):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return sorted([(d, len(s), least.get(g) if s else d) for (d, _), s, g in zip(rows, sets, group)], key=str)


def make_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "Ab", "ab", "ñ\xa0x"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 30, 60, 120]))]
        if g % 3 == 0:
            base = base[:10] + passage + base[10:]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: -rng.randint(1, 3)]
            texts.append(rng.choice([" ", "\n", "  "]).join(words))
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    return rows + [(None, rows[5][1]), (2000, None), (2001, ""), (2002, " \n"), rows[3]]


@pytest.mark.parametrize("block_grams", [100, 2_000_000])
def test_groups_agree_with_all_pairs(spark, block_grams):
    rows = make_rows(1)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    found = similar_documents(df, block_grams=block_grams).collect()
    assert sorted([tuple(r) for r in found], key=str) == expected(rows)


def test_empty_table_and_null_text(spark):
    assert similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, None, "x", 1)], SCHEMA)
    assert [tuple(r) for r in similar_documents(one).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_tree_links_what_all_pairs_link(seed):
    sets = [{hash(g) & ((1 << 63) - 1) for g in grams(text)} for _, text in make_rows(seed)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    pairs = all_links(sets)
    assert groups(linked_pairs(arrays, 80), len(sets)) == groups(pairs, len(sets))
    rng = random.Random(seed)
    side = [rng.randint(0, 1) for _ in sets]
    across = [(a, b) for a, b in pairs if side[a] != side[b]]
    assert groups(linked_pairs(arrays, 80, side), len(sets)) == groups(across, len(sets))


def test_shared_keys_in_batches_of_any_size(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 5)
    rng = random.Random(1)
    for _ in range(200):
        rows = sorted((rng.randint(0, 12), rng.randint(0, rng.choice([2, 30])), 7) for _ in range(rng.randint(0, 120)))
        names = {}
        for key, name, _ in rows:
            names.setdefault(key, set()).add(name)
        want = sorted((k, n, 7, min(5, len(v))) for k, v in names.items() if len(v) > 1 for n in v)
        batches, at = [], 0
        while at < len(rows):
            part = rows[at : at + rng.randint(1, 9)]
            at += len(part)
            columns = [pa.array([r[i] for r in part], pa.int64()) for i in range(3)]
            batches.append(pa.RecordBatch.from_arrays(columns, names=["key", "name", "n"]))
        got = sorted(tuple(r.values()) for b in ngram_join._shared(iter(batches)) for r in b.to_pylist())
        assert got == want


def test_components_of_a_star_a_chain_and_a_pair(spark):
    links = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 160)] + [(900, 901)]
    found = components(spark.createDataFrame([(b, a) for a, b in links], "a long, b long"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(40)), list(range(100, 161)), [900, 901]]
    assert all(name in members for name, members in groups.items())


def test_many_rows_without_id(spark):
    """Rows without id stand for classes of their own: each is told apart by its text."""
    rng = random.Random(21)
    rows, want = [], []
    for i in range(1200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(None, " ".join(words)), (i, " ".join(words[:-1] + ["end"]))]
        want += [(None, i), (i, i)]
    rows += [(None, rows[0][1])] * 300
    want += [(None, 0)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["component_id"]) for r in similar_documents(docs).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
