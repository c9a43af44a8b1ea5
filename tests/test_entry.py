import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Too slow to be run twice here; the driver runs them.
SLOW = {"context_pack", "html_report", "reading_path", "slice_text", "resolve_address", "pipeline", "focus_top"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def names():
    return [n for n in entry.queries() if not re.match(r"op\d", n) and n not in SLOW]


@pytest.mark.parametrize("name", names())
def test_query(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    if name not in entry.oracle_sql():
        assert df.columns
        return
    r = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    clean = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(clean, r.fetchall()), key=key) == sorted((clean(tuple(x[c] for c in cols)) for x in got), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
