"""Every registered SQL statement against its query, on whole tables of the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from catalog import ORACLES, QUERIES
from compare import norm, same


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v) if not isinstance(v, float) else "", v if isinstance(v, float) else 0) for v in
                                            [x for x in r if not isinstance(x, float)] + [x for x in r if isinstance(x, float)]))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = _sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()])
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = _sorted([tuple(norm(r[i]) for i in order) for r in rel.fetchall()])
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want) if not all(same(x, y) for x, y in zip(a, b))]
    assert not wrong, wrong[:3]


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
