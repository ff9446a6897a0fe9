"""Every query against its SQL on the smallest tables."""

import datetime
import decimal
import itertools
import math
import random

import duckdb
import pytest

import __spark_entry__ as entry
from terravane import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0 or 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_cubic_means_depend_on_no_order(spark, tmp_path, adaptive):
    # Centres at whole 8m + 4 weigh the 4 x 4 cells around them by 256ths; each block is filled so that its mean ends in a five at place seven,
    # which ten places show whole.
    r, cells, want = random.Random(1), [], {}
    w = (-1, 9, 9, -1)
    for m, n in itertools.product(range(8), repeat=2):
        k = 0
        while k % 16 != 8:
            held = {(i, j): r.randint(1, 10) for i, j in itertools.product(range(4), repeat=2)}
            k = sum(w[i] * w[j] * v for (i, j), v in held.items())
        cells += [(8 * m + 2 + i, 8 * n + 2 + j, 1, v / 100) for (i, j), v in held.items()]
        want[3 * m + 1, 3 * n + 1] = float(decimal.Decimal(k) / 25600)
    spark.createDataFrame(cells, "l_orderkey long, l_partkey long, l_linenumber int, l_discount double").repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = {(x["row"], x["col"]): x["value"] for x in entry.queries()["reproject_cubic"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
