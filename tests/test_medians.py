"""The medians of the analysis and of the corpus statistics."""

import statistics

from loomspark.operators import profile


def test_medians(spark):
    for rows in ([(7, 0.5)], [(3, 0.25), (8, 0.5), (8, 0.125), (2, 0.75)], [(k * k, 1 / (k + 1)) for k in range(9)]):
        got = profile.analysis_medians(spark.createDataFrame(rows, "token_est long, score double")).first()
        assert got.token_median == int(statistics.median(r[0] for r in rows))
        assert abs(got.score_median - statistics.median(r[1] for r in rows)) < 1e-12
    texts = ["a" * n for n in (5, 90, 400, 1200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tok = [r[0] for r in df.select(profile.X.token_estimate("text", profile.Curation().chars_per_token)).collect()]
    assert profile.corpus_medians(df).first().token_median == int(statistics.median(tok))
