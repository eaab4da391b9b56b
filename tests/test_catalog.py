"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from episodica.plans import catalog, problems, runs, traces  # noqa: F401  all register their queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9f}"
    if hasattr(v, "strftime"):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return f"{v:.9f}" if type(v).__name__ == "Decimal" else v if v is None or isinstance(v, (str, bool)) else f"{v:.9f}" if isinstance(v, int) else str(v)


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = df.collect()
    assert found
    if name in catalog.ORACLE:
        said = duck.execute(catalog.ORACLE[name])
        names = [c[0] for c in said.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(found, df.columns) == rows(said.fetchall(), names)


def test_whole_tables(spark, duck):
    all_lines = duck.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert catalog.QUERIES["exact_match_all"](spark, SF).count() == all_lines
    reviews = catalog.QUERIES["labeled_transitions"](spark, SF).count()
    found = catalog.QUERIES["events_with_all_metadata"](spark, SF)
    assert found.where("tier IS NOT NULL").count() == reviews == catalog.QUERIES["events_with_metadata"](spark, SF).count()


@pytest.mark.parametrize("name", ["bootstrap_ci_1000", "paired_delta_ci_1000"])
def test_intervals_take_1000_replicates(spark, name):
    """Those without a parsed pair have no rate, which happens on the smallest tables."""
    assert all(500 < r.replicates <= 1000 for r in catalog.QUERIES[name](spark, SF).collect())
