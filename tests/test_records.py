import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tabulon.errors import InvalidRequest
from tabulon.sources.readers import read_csv, read_tsv
from tabulon.sources.records import open_after

SCHEMA = "a string, b string, c string"


def one_task(spark, path, schema=SCHEMA, header=True):
    """The built-in reader, which reads a file with line breaks in cells as a whole."""
    return spark.read.options(header=header, multiLine=True, quote='"', escape='"', mode="PERMISSIVE").schema(schema).csv(path)


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in kept]
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_states_of_lines_follow_the_characters():
    def plain(line, is_open):
        state = "quoted" if is_open else "start"
        for c in line:
            if state == "quoted":
                state = "quote" if c == '"' else "quoted"
            elif c == ",":
                state = "start"
            elif c == '"' and state in ("start", "quote"):
                state = "quoted"
            else:
                state = "plain"
        return state == "quoted"

    rng, after = random.Random(3), open_after(",")
    for _ in range(20000):
        line = "".join(rng.choices('a",\r', k=rng.randint(0, 14)))
        for is_open in (False, True):
            assert after(line.encode(), is_open) == plain(line, is_open), (line, is_open)
    with pytest.raises(InvalidRequest):
        open_after('"')


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_equal_one_task(spark, tmp_path, small_splits, end):
    rng = random.Random(4)
    cells = ["", "x", '"a, b"', f'"two{end}lines"', f'"{end}{end}"', '""', '"say ""hi"""', f'","', f'"long {"é" * 60}{end}{"y" * 90}{end}"', "5 ft", 'in"ch', "日本", '"""' + end + '"""']
    folder = tmp_path / "t"
    folder.mkdir()
    for name in ("one", "two", "three"):
        lines = [",".join(rng.choice(cells) for _ in range(3)) for _ in range(40)]
        lines[20:20] = ["", ""]
        (folder / f"{name}.csv").write_bytes((end.join(["a,b,c", *lines]) + (end if name == "one" else "")).encode())
    (folder / "none.csv").write_bytes(b"")
    (folder / "broken.csv").write_bytes(end.join(["a,b,c", "1,2,3", '4,"never closed,5', "6,7,8", ",,"]).encode())

    def same_breaks(found):  # the built-in reader makes line feeds of the line ends inside cells
        return rows(found.select(*[F.replace(c, F.lit("\r\n"), F.lit("\n")).alias(c) for c in "abc"]))

    want = same_breaks(one_task(spark, str(folder)))
    for size in (1 << 27, 600, 150):
        small_splits(size)
        assert same_breaks(read_csv(spark, str(folder), schema=SCHEMA)) == want
    assert read_csv(spark, str(folder / "one.csv"), schema=SCHEMA).rdd.getNumPartitions() > 6
    plain = one_task(spark, str(folder / "two.csv"), header=False)
    assert same_breaks(read_csv(spark, str(folder / "two.csv"), schema=SCHEMA, header=False)) == same_breaks(plain)


def test_types_come_from_all_splits(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    body = "".join(f'{i},"line\nbreak {i}",{i / 4 if i > 90 else i},2024-01-{1 + i % 28:02d}\n' for i in range(100))
    path.write_text("﻿id,text,n,day,id\n" + "7\n" + body, encoding="utf-8")
    plain = spark.read.options(header=True, multiLine=True, quote='"', escape='"', inferSchema=True, preferDate=True).csv(str(path))
    small_splits(600)
    found = read_csv(spark, str(path), dates_as_strings=False)
    assert found.dtypes == plain.dtypes and rows(found) == rows(plain)
    assert dict(read_csv(spark, str(path)).dtypes)["day"] == "string"


def test_tables_without_rows(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("a\tb\n")
    found = read_tsv(spark, str(tmp_path / "h.tsv"))
    assert found.columns == ["a", "b"] and found.count() == 0
    assert read_tsv(spark, str(tmp_path / "h.tsv"), schema="a long, b string").count() == 0
