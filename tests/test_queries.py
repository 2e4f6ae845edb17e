import datetime
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, int):
        return float(x)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else str(x)


@pytest.fixture(scope="module")
def con():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, con, name):
    df, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = [plain(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    assert sorted(got, key=repr) == sorted((plain(r) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, con, name):
    assert QUERIES[name](spark, SF).count() >= 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_roots_by_form_broadcasts_neither_side(spark, con, tmp_path):
    cases = [("Anukkat", "{anuk:anuk/1n}{kat:kat/1vv}; {anu:anut/1v}"), ("anu", "{anuq:anuq/2n}"), ("anukk", "{an:an/1n}; {anukt:anukt/1v}"), ("x-y", "{anu:anu/1v}"), (None, None)]
    spark.createDataFrame(cases, "word string, all_correct_decomps string").write.parquet(f"{tmp_path}/analyzer_cases.parquet")
    df = QUERIES["j09_roots_by_form"](spark, str(tmp_path))
    # The beginnings of words are many more than the optimizer believes, so that it would broadcast them from small files.
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    own = con.cursor()
    own.execute(f"CREATE TEMP VIEW analyzer_cases AS SELECT * FROM '{tmp_path}/analyzer_cases.parquet/*.parquet'")
    want = own.execute(ORACLES["j09_roots_by_form"]).fetchall()
    got = [tuple(r) for r in df.select("word", "stem", "identifier").collect()]
    assert sorted(got) == sorted(want) and ("anukkat", "anuk", "1n") in got and ("anu", "anuq", "2n") in got


def test_trained_scores_make_features_of_all_rows_once(spark, monkeypatch):
    from lexigrid.operators import candidates
    from lexigrid.plans import features

    made, real = [], candidates.places
    monkeypatch.setattr(candidates, "places", lambda rows: made.append(rows.select("word_id").distinct().count()) or real(rows))
    monkeypatch.setattr(features.training_rows, "__defaults__", (50, 40))
    first, again = (sorted(map(tuple, QUERIES["m05_trained_scores"](spark, SF).collect())) for _ in range(2))
    assert made[0] <= 50 < made[1] and made[:2] == made[2:] and first == again
    # The driver holds a plan of few joins and shuffles.
    assert QUERIES["m05_trained_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange") < 20
