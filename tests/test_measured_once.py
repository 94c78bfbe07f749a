"""Costly passes over texts run once: what follows reads what they stored."""

from loomspark.operators import dedup
from loomspark.plans import queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_curate_whole_measures_once(spark, sf_dir):
    df = queries.curate_whole(spark, sf_dir)
    assert "EvalPython" not in plan(df) and "regexp" not in plan(df)
    assert df.count()


def test_near_stores_no_signature_per_band(spark, monkeypatch):
    made, real = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df: made.append(df.columns) or real(df))
    rows = [(i, 0.5, " ".join(f"w{j}" for j in range(i, i + 9))) for i in range(8)]
    assert dedup.near(dedup.with_signature(spark.createDataFrame(rows, "id long, score double, text string"))).count()
    assert made and not any("band" in c and "signature" in c for c in made)


def test_curate_corpus_measures_once(spark, sf_dir):
    df = queries.curate_corpus(spark, sf_dir)
    assert "EvalPython" not in plan(df) and "regexp" not in plan(df)
