import random
from collections import defaultdict

from tabulon.llm.chat import format_windows, loss_text_of, turns_of
from tabulon.llm.op2 import HARD_TEXT, op2_chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def make_rows():
    rng, rows = random.Random(3), []
    for conv in range(60):
        for turn in range(rng.randint(1, 14)):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "a<b>\\c\n", None, "system"])
            text = rng.choice([None, "", "\\l<>\\b</turn>\n", HARD_TEXT, "é日 word " * rng.randint(1, 40), "x y, z. " * rng.randint(1, 120)])
            rows.append((conv or None, turn // 2 if conv % 5 == 0 else turn, role, text, "clash"))
    return rows + [rows[3]] * 3


def test_turns_and_targets_are_read_back(spark):
    rows = make_rows()
    windows = format_windows(spark.createDataFrame(rows, SCHEMA), 100, 30)
    turns, loss = defaultdict(list), defaultdict(str)
    for r in windows.select("*", turns_of(windows).alias("turns"), loss_text_of(windows).alias("target")).orderBy("conv_id", "window").collect():
        turns[r["conv_id"]] += [tuple(t) for t in r["turns"]]
        loss[r["conv_id"]] += r["target"]
        assert r["n_tokens"] <= 100 or r["n_new"] <= 1
    want = defaultdict(list)
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    assert turns == want
    assert loss == {c: "".join(t for r, t in x if r == "assistant") for c, x in want.items()}


def test_system_turn_and_history_are_repeated_and_masked(spark):
    rows = [(1, 0, "system", "be kind", "")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"w{i} " * 10, "") for i in range(1, 9)]
    found = format_windows(spark.createDataFrame(rows, SCHEMA), 60, 20).orderBy("window").collect()
    assert len(found) > 2 and all(r["n_system"] == 1 and "be kind" in r["formatted"] for r in found)
    assert any(r["n_history"] for r in found)
    text = "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for r in found for s in r["loss"])
    assert text == "".join(f"w{i} " * 10 for i in (2, 4, 6, 8))


def test_empty_table(spark):
    assert format_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hard_conversation(spark):
    found = {r["conv_id"]: r for r in op2_chat(spark, "/root/testdata/sf0.001").collect()}
    assert found[-7]["n_turns"] == 2 and found[-7]["loss_chars"] == len(HARD_TEXT)


def test_the_budget_holds_wherever_system_and_new_turns_fit(spark):
    """Turns longer than a stride, and system turns that leave almost no stride, shed history."""
    rng = random.Random(6)
    rows = [(1, i, "user", "w " * n, "") for i, n in enumerate([60, 60, 80, 900, 5, 100, 1200, 3])]
    rows += [(2, i, "system" if not i else "user", "w " * n, "") for i, n in enumerate([900, 60, 60, 60, 1, 30, 200])]
    rows += [(c, i, "system" if not i and c % 2 else "user", "w " * rng.choice([1, 40, 300, 700, 1100]), "") for c in range(3, 30) for i in range(12)]
    found = format_windows(spark.createDataFrame(rows, SCHEMA), 1024, 256).collect()
    tokens = {(c, i + 1): len(t.split()) + 4 for c, i, _, t, _ in rows}
    shed = 0
    for r in found:
        begin = 2 if r["n_system"] and r["first"] == 1 else r["first"]
        new = sum(tokens[r["conv_id"], begin + j] for j in range(r["n_new"]))
        system = tokens[r["conv_id"], 1] if r["n_system"] else 0
        assert r["n_tokens"] <= max(1024, system + new), r["conv_id"]
        shed += r["n_history"] == 0 and r["first"] > 2
    assert shed and any(r["n_history"] for r in found)
    assert {(r["conv_id"], r["first"]): r["n_tokens"] for r in found}[1, 4] <= 1024
