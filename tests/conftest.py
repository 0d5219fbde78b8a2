import pytest

from tabulon.session import ensure_checkpoint_dir, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales(spark):
    """Four sales: the small table most expectations are worked out on by hand."""
    return spark.createDataFrame(
        [("Alpha", 100, 10, "East"), ("Beta", 200, 20, "West"), ("Gamma", 150, 15, "East"), ("Delta", 300, 30, "West")],
        "name string, amount long, qty long, region string",
    )


@pytest.fixture(scope="session")
def dated(spark):
    return spark.createDataFrame(
        [("2024-01-01", 100, "East"), ("2024-01-02", 200, "West"), ("2024-01-03", 150, "East"), ("2024-01-10", 300, "West")],
        "date string, amount long, region string",
    )


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    found = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(found, key=lambda r: [(v is not None, str(type(v)), v) if not isinstance(v, (list, dict)) else (True, "", str(v)) for v in r])
