"""Text functions against Python's own definitions, on texts that the tables don't hold."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import keywords as K
from loomspark.functions import replies
from loomspark.functions import text as X

TEXTS = ["", " ", "a\r\nb\rc", "x\t\t y  z", "p\n\n\n\nq", "  ends ", "One. Two?! “Three.” Four… five", "Слово и étude 12_b 😀", "a.b. c", "no end", "Mr. Fox!", " Wide "]


def col(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f("t")).collect()]


def clean(t):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub("\r\n?", "\n", t))).strip()


def sentences(t):
    out, at = [], 0
    for m in re.finditer(r"[.!?…]+[\"'”’»)\]]*(?=\s)", t):
        out.append(t[at : m.end()])
        at = m.end()
    return [s.strip() for s in [*out, t[at:]] if s.strip()]


def test_clean_words_sentences(spark):
    assert col(spark, TEXTS, X.clean) == [clean(t) for t in TEXTS]
    assert col(spark, TEXTS, X.sentences) == [sentences(t) for t in TEXTS]
    plain = [t for t in TEXTS if "́" not in t]
    assert col(spark, plain, X.words) == [re.findall(r"\w+", t.lower()) for t in plain]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB .!?\n\t\r\"”,-", max_size=30), min_size=20, max_size=20))
def test_clean_and_sentences_on_random_texts(spark, texts):
    assert col(spark, texts, X.clean) == [clean(t) for t in texts]
    assert col(spark, texts, X.sentences) == [sentences(t) for t in texts]


def test_tokens_and_shingles(spark):
    assert col(spark, ["", "abc", "abcd", "a" * 799, "a" * 800], X.token_estimate) == [0, 1, 1, 199, 200]
    assert col(spark, [""], lambda c: X.token_estimate(c, 4.0, 1)) == [1]
    assert col(spark, ["", "a b", "a b c d e f"], lambda c: X.shingles(X.words(c), 5)) == [[], ["a b"], ["a b c d e", "b c d e f"]]


def test_small_functions(spark):
    assert col(spark, [" First-Meeting!", "a  b", "__x__"], X.norm_label) == ["first_meeting", "a_b", "x"]
    assert col(spark, ["My Model/7B!", "--a"], X.slug) == ["my-model-7b", "a"]
    assert col(spark, ["1.2.3", "0.5rc1.x.9"], X.version_parts) == [[1, 2, 3], [0, 51, 0]]
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(X.duration(F.lit(3725)), X.duration(F.lit(184)), X.duration(F.lit(5)), X.percent(F.lit(1), F.lit(8)), X.percent(F.lit(1), F.lit(0))))).collect()] == ["1h02m", "3m04s", "5s", "12.5%", "0.0%"]


def test_seams(spark):
    segs = ["One ", " ", "Two\t x", "Three"]
    df = spark.createDataFrame([(segs,), ([" "],)], "s array<string>")
    (text, mark, offs), none = df.select(X.marked(F.col("s"), False), X.marked(F.col("s"), True), X.seam_offsets(F.col("s"))).collect()
    assert text == "One\n\nTwo x\n\nThree" and mark == "One\n\n⟦J1⟦\n\nTwo x\n\n⟦J2⟦\n\nThree"
    assert [text[o:].split("\n\n")[0] for o in offs] == ["Two x", "Three"]
    assert tuple(none) == ("", "", [])


def test_keywords(spark):
    words = ["magic", "magic sword", "c++", "magic"]
    p = K.pattern(words)
    assert col(spark, ["MAGIC sword, Magic; c++ and c++x", "magician"], lambda c: K.matched(c, p)) == [["magic", "c++"], []]
    assert spark.range(1).select(K.share(F.lit(2), words)).first()[0] == 0.5


def test_unfound(spark):
    df = spark.createDataFrame([(['"Rome"', "Oslo", "", " 'x' "], "In rome, X."), (None, "t")], "e array<string>, t string")
    assert [r[0] for r in df.select(X.unfound(F.col("e"), "t")).collect()] == [["Oslo"], []]


def test_replies():
    assert replies.first_object('```json\n{"a": "}"}\n```') == '{"a": "}"}'
    assert replies.first_object('so: {"a": {"b": "\\"{"}} end') == '{"a": {"b": "\\"{"}}'
    assert replies.first_object("none") is None and replies.first_object(None) is None and replies.first_object('{"a": 1') is None
    assert replies.repaired('{"a": ["x",, "y",], "b": [1') == '{"a": ["x", "y"], "b": [1]}'
    assert replies.repaired("{oops") is None
