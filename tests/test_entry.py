"""The entry point, sources, streaming, and the queries against their SQL on the smallest tables."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from loomspark.plans import oracle, queries
from loomspark.sources import readers, writers
from loomspark.streaming import tagging as stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def canonical(rows, columns):
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.sql(oracle.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert canonical([r.asDict() for r in got.collect()], cols) == canonical([dict(zip(want.columns, r)) for r in want.fetchall()], cols)


def test_without_llm(tmp_path):
    for f in ("loomspark", "__spark_entry__.py"):
        src = os.path.join(ROOT, f)
        shutil.copytree(src, tmp_path / f, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path / f)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'curate_corpus' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n\n{"text": "y"}\n')
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\n{oops\n')
    (tmp_path / "empty.jsonl").write_text("\n")
    assert [r.text for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "text string").collect()] == ["x", "y"]
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "text string").collect()
    with pytest.raises(ValueError):
        readers.jsonl(spark, str(tmp_path / "empty.jsonl"))
    assert [r.text for r in readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "text string", strict=False).collect()] == ["x"]
    (tmp_path / "k.txt").write_text("# c\n\nMagic\nmagic\n")
    assert readers.keywords(spark, str(tmp_path / "k.txt")) == ["magic", "magic"]
    assert readers.keywords(spark, str(tmp_path / "k.txt"), distinct=True) == ["magic"]
    assert readers.keywords(spark, None) == readers.DEFAULT_KEYWORDS
    (tmp_path / "v.txt").write_text("lost\n[tone]\nwarm    # 3\nwarm\n#x\n[setting]\n")
    assert readers.vocabulary(spark, str(tmp_path / "v.txt")) == {"tone": ["warm", "warm"], "setting": []}
    (tmp_path / "p.txt").write_text("One\nline\n\n# no\n\n Two \n")
    assert [r.prompt for r in readers.prompts(spark, str(tmp_path / "p.txt")).collect()] == ["One\nline", "Two"]
    (tmp_path / "s.csv").write_text("scene_id,score,x\n1,0.5,a\n1,0.7,b\n2,0.1,c\n")
    assert sorted(map(tuple, readers.scores(spark, str(tmp_path / "s.csv")).collect())) == [("1", 0.7), ("2", 0.1)]
    for n, meta in (("r1", {"created": "2024-01-02T03:04:05", "lora": {"r": 8}, "metrics": {"train_loss": 1.23456}}), ("r2", {})):
        (tmp_path / "runs" / n).mkdir(parents=True)
        (tmp_path / "runs" / n / "run.json").write_text(json.dumps(meta))
    got = {r.name: r for r in readers.runs(spark, str(tmp_path / "runs")).collect()}
    assert (got["r1"].created, got["r1"].r, got["r1"].loss) == ("2024-01-02 03:04", 8, 1.235) and got["r2"].r is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", 0, "train", 5, "a"), ("2", 0, "val", 6, "b")], readers.MANIFEST)
    writers.manifest(df, str(tmp_path / "m"))
    assert {r.scene_id for r in spark.read.json(str(tmp_path / "m")).where("split = 'val'").collect()} == {"2"}
    writers.vocabulary(spark.createDataFrame([("tone", "b", 2), ("tone", "a", 2), ("tone", "c", 1)], "facet string, label string, n long"), str(tmp_path / "v"), 2)
    text = [r[0] for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert text[text.index("[tone]") :][:3] == ["[tone]", "a    # 2", "b    # 2"]


def test_streaming_tags_once(spark, tmp_path):
    from loomspark.operators.tagging import lexical_tagger

    vocab = {"tone": ["warm"], "setting": ["sea"]}
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    read = lambda: spark.readStream.schema("scene_id string, text string").json(str(src))
    for n, ids in ((1, "ab"), (2, "bc")):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"scene_id": i, "text": "a warm sea"}) for i in ids))
        stream.run(read(), str(out), str(tmp_path / "cp"), lexical_tagger(vocab), vocab).awaitTermination()
    got = spark.read.schema(readers.TAGS).json(str(out)).collect()
    assert sorted(r.scene_id for r in got) == ["a", "b", "c"] and all(r.parse_ok and r.facets == {"tone": ["warm"], "setting": ["sea"]} for r in got)
