import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulon.llm import manifest as module
from tabulon.llm.base import ORACLES
from tabulon.llm.manifest import bitmap_index, folded, leaf_hash, manifest, proof_digest
from tabulon.llm.op11 import op11_merkle_manifest

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=False):
    parts = []
    for name in NAMES:
        v = row[name] if name != "text" or text is False else text
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*parts)


def climb(nodes):
    """The root over some nodes, and for each of them the siblings before and after it, level by level."""
    paths, runs = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, merged = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for j in range(len(run)):
                for i in runs[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            merged.append(sum(runs[a : a + 3], []))
        nodes, runs = up, merged
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subroot, paths = climb([leaf(r) for r in ordered])
        subroots.append(subroot)
        found.append((ordered, paths))
    if not names:
        return []
    root, above = climb(subroots)
    out = []
    for (ordered, paths), subroot, rest in zip(found, subroots, above):
        for r, path in zip(ordered, paths):
            path = path + rest
            cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            at = leaf(r, r["text"].replace("\n", "") if cut else r["text"])
            for before, after in path:
                at = h(before, at, after)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*[x for p in path for x in p]), at, at == root))
    return sorted(map(str, out))


def got(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    schema = "doc_id long, source string, lang string, n_chars long, text string, slot long, hash string"
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) + (1, "x") for r in rows], schema)
    df.repartition(5).write.parquet(str(path / "documents.parquet"))
    found = op11_merkle_manifest(spark, str(path))
    return sorted(str(tuple(r)) for r in found.collect()), path


def row(doc_id, source, text="a\nb", lang="en", n_chars=3):
    return dict(zip(NAMES, (doc_id, source, lang, n_chars, text)))


def odd_rows():
    rng = random.Random(3)
    rows = [row(i, "hot", f"t{i}\n") for i in range(800)]
    rows += [row(rng.getrandbits(64) - (1 << 63), "wide", str(i)) for i in range(120)]
    rows += [row(-1, "edge"), row(-(1 << 63), "edge"), row((1 << 63) - 1, "edge"), row(63, "edge"), row(64, "edge"), row(-64, "edge")]
    rows += [row(None, "hot", f"n{i}") for i in range(40)] + [row(None, "hot", "same")] * 30
    rows += [row(5, "twice", f"x{i % 7}") for i in range(60)] + [row(6, "twice", "x")]
    rows += [row(1, None, None, None, None), row(2, "", "", "", 0), row(3, "Ünï", "ß\n\n"), row(4, "one"), row(7, "three"), row(8, "three"), row(9, "three")]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_equal_to_brute_force(spark, tmp_path_factory, monkeypatch, levels):
    monkeypatch.setattr(module, "LEVELS", levels)
    monkeypatch.setattr(module, "WIDTH", 3**levels)
    rows = odd_rows() if levels > 1 else odd_rows()[-220:]
    found, _ = got(spark, rows, tmp_path_factory)
    assert found == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_small_groups_and_the_sql(spark, tmp_path_factory, n):
    rows = [row(i * 3, f"s{i % 4}" if i < 9 else "last") for i in range(n)]
    found, path = got(spark, rows, tmp_path_factory)
    assert found == brute(rows)
    if n:
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        assert sorted(map(str, c.execute(ORACLES["op11_merkle_manifest"]).fetchall())) == found


def test_bitmaps_count_what_lies_before(spark):
    ids = [-130, -1, 0, 1, 63, 64, 200, 1 << 40, (1 << 40) + 1]
    rows = spark.createDataFrame([("g", i) for i in ids] + [("g", None), ("other", 5)], "group string, id long")
    found = {(r["group"], r["word"]): (r["n"], r["before"], r["total"]) for r in bitmap_index(rows).collect()}
    assert found[("other", 0)] == (1, 0, 1)
    assert found[("g", 0)] == (3, 3, 10) and found[("g", 1 << 34)] == (2, 8, 10)
    assert sum(n for (g, _), (n, _, _) in found.items() if g == "g") == 10


def test_paths_prove_rows_and_nothing_else(spark):
    docs = spark.createDataFrame([(i, "s", f"t{i}") for i in range(300)], "doc_id long, source string, text string")
    found = manifest(docs, ("doc_id", "text")).where(F.col("doc_id") % 50 == 0)
    right = folded(leaf_hash([F.col("doc_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string"))]), F.col("path"))
    wrong = folded(leaf_hash([F.col("doc_id"), F.lit("t")]), F.col("path"))
    for r in found.select("root", "subroot", right.alias("a"), wrong.alias("b"), proof_digest(F.col("path")).alias("p")).collect():
        assert r["a"] == r["root"] == r["subroot"] != r["b"]
    assert manifest(docs.limit(0), ("doc_id", "text")).count() == 0
