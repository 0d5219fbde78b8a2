import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tabulon.llm import packing
from tabulon.llm.packing import batch_encoder, encoder, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, part string"


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {room: j for j, room in enumerate(rooms) if room >= items[i]}.values():
            rooms[j] -= items[i]
            go(i + 1, rooms)
            rooms[j] += items[i]
        rooms.append(capacity - items[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


def check_plan(counts, capacity):
    segments, sequences, _ = plan(counts, capacity)
    ranks, held = {}, {}
    for length, first, n, sequence, each, offset in segments.tolist():
        for q in range(n):
            ranks.setdefault(length, []).append(first + q)
            held.setdefault(sequence + q // each, []).append((offset + q % each * length, length))
    assert all(sorted(ranks[length]) == list(range(n)) for length, n in counts.items())
    assert sorted(held) == list(range(sequences))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_plans_are_valid_and_best_for_small_instances():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        assert check_plan({x: items.count(x) for x in items}, capacity) == optimum(items, capacity)
    for _ in range(100):
        capacity = rng.choice([50, 100])
        check_plan({rng.randint(1, capacity): rng.randint(1, 300) for _ in range(rng.randint(1, 40))}, capacity)


def test_encoder_agrees_with_the_tokenizer():
    tokenizer, encode, rng = Tokenizer.from_file(PATH), encoder(PATH), random.Random(4)
    pools = [
        [chr(c) for c in range(1, 0x250)], [chr(c) for c in range(33, 127)], [*"abcé' \n.,'sdreÉß1²³ªº", "'s", "<|endoftext|>", "<|"],
        [chr(c) for c in range(1, 0x3000)],
    ]
    for k in range(8000):
        text = "".join(rng.choice(pools[k % 4]) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_and_places(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["one two three", None, "", "word " * 50, "a b " * 40, "one two three", "x, y! " * 9] * 3
    rows = [(i if i % 5 else None, t, 1, "clash") for i, t in enumerate(texts)]
    found = pack(spark.createDataFrame(rows, SCHEMA), PATH, capacity=32).collect()
    want = []
    for doc, text, _, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 32)):
            part = ids[start : start + 32]
            want.append((doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in found], key=str) == sorted(want, key=str)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for each in places.values():
        at = 0
        for offset, length in sorted(each):
            assert offset == at
            at += length
        assert at <= 32


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_a_worker_loads_a_tokenizer_once():
    path = PATH
    assert encoder(path) is encoder(path)


def test_batches_of_texts_agree_with_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 60)
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(5)
    encode = batch_encoder(tokenizer)
    parts = ["word", "Word,", "it's", "x\ty", " ", "\n\n", "\u00c9t\u00e9.", "$$$", "\u4e2d\u6587", "<|endoftext|>", "a" * 150]
    texts = ["", *["".join(rng.choice(parts) + rng.choice([" ", "\r\n", ""]) for _ in range(rng.randint(0, 12))) for _ in range(300)], " "]
    found = []
    for first, batch in packing._parts(pa.array(texts)):
        assert first == len(found)
        ids, bounds = encode(batch)
        found += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_frequent_word_is_tokenized_once_however_many_rare_ones_come(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_PIECES", 50)
    model, calls = Tokenizer.from_file(PATH).model, Counter()

    def tokenize(text):
        calls[text] += 1
        return model.tokenize(text)

    encode = batch_encoder(SimpleNamespace(model=SimpleNamespace(tokenize=tokenize)))
    for k in range(100):
        rare = ["".join(chr(97 + int(d)) for d in f"{k * 20 + i:05}") for i in range(20)]
        encode(pa.array([" ".join(["Common,", *rare, "common"])]))
    assert calls["common"] == calls[","] == 1 and len(calls) == 2002


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import public_tokenizers
from pyspark.sql import SparkSession
from tabulon.llm.packing import pack
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = [(i, "some words, again") for i in range(20)]
docs = spark.createDataFrame(rows, "doc_id long, text string")
assert pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 20
print("all ran")
"""


def test_workers_pack_without_a_copy_of_the_package(tmp_path):
    root = str(Path(__file__).parent.parent.parent)
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]
