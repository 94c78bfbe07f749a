"""Every labelled language is learned, however many there are."""

from loomspark.llm import langid


def test_more_than_64_languages(spark):
    # the 65th to 70th languages are the rarest; each has a letter of its own
    rows, letters = [], [chr(0x4E00 + 97 * k) for k in range(70)]
    for k in range(70):
        rows += [(1000 * k + i, f"l{k:02d}", letters[k] * (20 + i)) for i in range(8 if k < 64 else 6)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    m = langid.train(d)
    assert m["langs"] == [f"l{k:02d}" for k in range(70)]
