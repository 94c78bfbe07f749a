"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from loomspark.llm import _blocks as B


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir):
    from loomspark.llm import bpe

    return bpe.round_trip(B.documents(spark, sf_dir), tokenizer_path())


def op8_exact_dedup(spark, sf_dir):
    from loomspark.llm import exact_dedup

    return exact_dedup.groups(B.documents(spark, sf_dir))


def op2_line_dedup(spark, sf_dir):
    from loomspark.llm import line_dedup

    return line_dedup.drop_lines(B.documents(spark, sf_dir)).drop("kept")


def op10_topk_search(spark, sf_dir):
    from loomspark.llm import topk_search

    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("read")


def op1_quality(spark, sf_dir):
    from loomspark.llm import quality

    docs = B.documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_language_id(spark, sf_dir):
    from loomspark.llm import langid

    docs = B.documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op9_lm_scores(spark, sf_dir):
    from loomspark.llm import lm

    return lm.score(B.documents(spark, sf_dir))


def op3_near_dedup(spark, sf_dir):
    from loomspark.llm import near_dedup

    return near_dedup.classes(B.documents(spark, sf_dir))


def op4_packing(spark, sf_dir):
    from loomspark.llm import packing

    return packing.packed(B.documents(spark, sf_dir), tokenizer_path())


def op7_suffix_dedup(spark, sf_dir):
    from loomspark.llm import suffix_dedup

    return suffix_dedup.cut_repeats(B.documents(spark, sf_dir), kept="")


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


_SQL = {
    "op8_exact_dedup": """
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from d window w as (partition by norm)""",
    "op2_line_dedup": """
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (select *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.key is null), '')) as kept_sha256
from k left join f using (key) group by r, doc_id""",
    "op10_topk_search": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
}


def oracle_sql():
    return dict(_SQL)
