import pytest

from conftest import rows
from tabulon.errors import EmptyInput, InvalidRequest
from tabulon.operators.joins import join_preview, join_sample, join_tables, require_rows


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, v string")
    right = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "k long, v string")
    return left, right


EXPECTED = {
    "inner": (["k", "v", "v__right"], [(2, "b", "x"), (2, "c", "x")]),
    "left": (["k", "v", "v__right"], [(None, "d", None), (1, "a", None), (2, "b", "x"), (2, "c", "x")]),
    "right": (["v", "k", "v__right"], [(None, None, "z"), (None, 3, "y"), ("b", 2, "x"), ("c", 2, "x")]),
    "full": (
        ["k", "v", "k_r", "v__right"],
        [(None, None, None, "z"), (None, None, 3, "y"), (None, "d", None, None), (1, "a", None, None), (2, "b", 2, "x"), (2, "c", 2, "x")],
    ),
    "semi": (["k", "v"], [(2, "b"), (2, "c")]),
    "anti": (["k", "v"], [(None, "d"), (1, "a")]),
}


@pytest.mark.parametrize("how", EXPECTED)
def test_every_kind(sides, how):
    out = join_tables(*sides, ["k"], how=how)
    columns, expected = EXPECTED[how]
    assert out.columns == columns
    assert rows(out) == expected


@pytest.mark.parametrize("how", EXPECTED)
def test_preview_counts_what_the_join_gives(sides, how):
    left, right = sides
    preview = join_preview(left, right, ["k"], how=how).first()
    joined = join_tables(left, right, ["k"], how=how)
    assert (preview["left_rows"], preview["right_rows"], preview["joined_rows"]) == (4, 3, joined.count())
    assert preview["columns"] == ",".join(joined.columns)


def test_self_join_multiplies_equal_keys(sales):
    assert join_tables(sales, sales, ["region"]).count() == 8


def test_differently_named_keys(spark, sales):
    places = spark.createDataFrame([("East", 10, "E"), ("West", 99, "W")], "place string, size long, region string")
    out = join_tables(sales, places, ["region", "qty"], ["place", "size"], "left")
    assert out.columns == ["name", "amount", "qty", "region", "region__right"]
    assert rows(out, "name", "region__right") == [("Alpha", "E"), ("Beta", None), ("Delta", None), ("Gamma", None)]


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_heavy_key_keeps_all_rows(spark, how):
    left = spark.range(900).selectExpr("CASE WHEN id < 300 THEN 7 ELSE id END AS k", "id AS l")
    right = spark.range(90).selectExpr("CASE WHEN id < 30 THEN 7 ELSE id + 880 END AS k", "id AS r")
    ours = join_tables(left, right, ["k"], how=how)
    assert ours.count() == left.join(right, "k", how).count()


def test_refusals(sides, sales):
    left, right = sides
    for arguments in ((["k"], ["k", "v"], "inner"), ([], [], "inner"), (["k"], ["k"], "cross"), (["nope"], ["k"], "inner")):
        with pytest.raises(InvalidRequest):
            join_tables(left, right, *arguments)
    with pytest.raises(EmptyInput):
        require_rows(join_tables(left.filter("k = 1"), right, ["k"]))
    assert join_sample(join_tables(sales, sales, ["region"]), 3).count() == 3
