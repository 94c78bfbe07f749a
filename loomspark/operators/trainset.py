"""Training examples: formats, validation, token rows with masked labels, and padded batches."""

from __future__ import annotations

import functools
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as X

IGNORED = -100
#: Fixed value: ids below it are the stand-in tokenizer's padding, begin and end tokens, which no word gets.
_SPECIAL_IDS = 3
_CHAT = "array<struct<role:string,content:string>>"


def detect_format(df: DataFrame, text_field: str = "text") -> str:
    names = set(df.columns)
    if "messages" in names:
        return "chat"
    if names & {"instruction", "prompt", "completion"}:
        return "instruction"
    if text_field in names:
        return "text"
    raise ValueError(f"no known format: expected {text_field}, instruction and output, or messages among {sorted(names)}")


def _plain(df: DataFrame, name: str) -> Column:
    return X.strip(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def judged(df: DataFrame, fmt: str = "auto", text_field: str = "text", min_chars: int = 1) -> DataFrame:
    """df with ``prompt_text``, ``target_text`` and ``status``: ok, invalid (an empty side, or fewer than two messages) or short.

    Chat: the last message is the target, and the length is that of the messages as JSON.
    """
    fmt = detect_format(df, text_field) if fmt == "auto" else fmt
    target, size = F.col("target_text"), F.length("target_text")
    if fmt == "text":
        p, t, ok = F.lit(""), _plain(df, text_field), target != ""
    elif fmt == "instruction":
        pair = {"prompt", "completion"} & set(df.columns)
        a, extra, t = (_plain(df, "prompt"), F.lit(""), _plain(df, "completion")) if pair else (_plain(df, "instruction"), _plain(df, "input"), _plain(df, "output"))
        p, ok = F.when(extra != "", F.concat(a, F.lit("\n\n"), extra)).otherwise(a), (a != "") & (target != "")
    elif fmt == "chat":
        m = F.col("messages").cast(_CHAT)
        asked = F.filter(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), lambda x: x["role"] != "assistant")
        p, t, size = F.array_join(F.transform(asked, lambda x: x["content"]), "\n"), F.try_element_at(m, F.lit(-1))["content"], F.length(F.to_json(m))
        ok = F.coalesce(F.size(m) >= 2, F.lit(False))
    else:
        raise ValueError(f"unknown format {fmt}")
    out = df.withColumns({"prompt_text": X.once(p), "target_text": X.once(t)})
    return out.withColumn("status", F.when(~ok, "invalid").when(size >= min_chars, "ok").otherwise("short"))


def extracted(df: DataFrame, fmt: str = "auto", text_field: str = "text", min_chars: int = 1) -> DataFrame:
    """The rows of judged() that are ok."""
    return judged(df, fmt, text_field, min_chars).where("status = 'ok'").drop("status")


def validation(rows: DataFrame) -> DataFrame:
    """(total, kept, invalid, short): one row of counts of judged() rows."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count("*").alias("total"), n("ok").alias("kept"), n("invalid").alias("invalid"), n("short").alias("short"))


def validated(df: DataFrame, fmt: str = "auto", text_field: str = "text", min_chars: int = 1) -> tuple[DataFrame, dict]:
    """(rows that are ok, the counts of validation()); a table without any raises."""
    rows = judged(df, fmt, text_field, min_chars)
    counts = validation(rows).first().asDict()
    if not counts["kept"]:
        raise ValueError(f"no valid examples: {counts}")
    return rows.where("status = 'ok'").drop("status"), counts


def template(prompt: Column) -> Column:
    """Fixed value: the fallback chat template before the answer."""
    return F.concat(F.lit("### Запрос:\n"), prompt, F.lit("\n\n### Ответ:\n"))


def tokenized(df: DataFrame, encode, eos_id: int, add_eos: bool = True) -> DataFrame:
    """df of extracted() with ``input_ids`` and ``labels``: prompt ids are masked. encode: a Column function from text to array<int>."""
    has = F.col("prompt_text") != ""
    head = F.when(has, encode(template(F.col("prompt_text")))).otherwise(F.array().cast("array<int>"))
    whole = encode(F.when(has, F.concat(template(F.col("prompt_text")), F.col("target_text"))).otherwise(F.col("target_text")))
    step = df.withColumns({"_head": X.once(head), "_ids": X.once(whole)})
    if add_eos:
        step = step.withColumn("_ids", F.when(F.coalesce(F.try_element_at("_ids", F.lit(-1)) == eos_id, F.lit(False)), F.col("_ids")).otherwise(F.concat("_ids", F.array(F.lit(eos_id)))))
    return step.withColumns({"input_ids": F.col("_ids"), "labels": masked(F.col("_ids"), F.size("_head"))}).drop("_head", "_ids")


def masked(ids: Column, n_prompt: Column) -> Column:
    """Labels: the ids, with the prompt's replaced by the ignored label."""
    n = F.least(n_prompt, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(ids, n + 1, F.size(ids)))


def word_encoder(text: Column) -> Column:
    """A stand-in tokenizer without a model: an id for each run of characters that aren't white space, never a special one."""
    return F.transform(F.filter(F.split(text, f"{X.SPACE}+", -1), lambda w: w != ""), lambda w: (F.pmod(F.crc32(w.cast("binary")), F.lit(32000 - _SPECIAL_IDS)) + _SPECIAL_IDS).cast("int"))


def tokenizer_encoder(path: str):
    """A Column function from text to the ids of a tokenizer file, without special tokens; null of null. Runs on Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        tok = _tokenizer(path)
        ids = iter([e.ids for e in tok.encode_batch_fast([t for t in texts if t is not None], add_special_tokens=False)])
        return texts.map(lambda t: None if t is None else next(ids))

    return run.asNondeterministic()  # else filters on lengths would have it run twice


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def chat_template(messages: Column, begin: str = "<|im_start|>", end: str = "<|im_end|>", ask: bool = False) -> Column:
    """Messages in a chat template with begin and end marks; ``ask`` opens the assistant's answer at the end."""
    turns = F.transform(messages.cast(_CHAT), lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(end + "\n")))
    text = F.array_join(turns, "")
    return F.concat(text, F.lit(begin + "assistant\n")) if ask else text


def tokenized_chat(df: DataFrame, encode, eos_id: int, messages: str = "messages", **marks) -> DataFrame:
    """df with ``input_ids`` and ``labels`` of templated chats: all but the last message's answer is masked."""
    m = F.col(messages).cast(_CHAT)
    head = chat_template(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), ask=True, **marks)
    step = df.withColumns({"_head": X.once(encode(head)), "_ids": X.once(encode(F.concat(head, F.try_element_at(m, F.lit(-1))["content"])))})
    step = step.withColumn("_ids", F.concat("_ids", F.array(F.lit(eos_id))))
    return step.withColumns({"input_ids": F.col("_ids"), "labels": masked(F.col("_ids"), F.size("_head"))}).drop("_head", "_ids")


def fitted(df: DataFrame, max_len: int, overlong: str = "drop") -> DataFrame:
    """df with ``length``: rows beyond max_len dropped, or cut with ``truncated`` set, by choice."""
    n = F.size("input_ids")
    if overlong == "drop":
        return df.where(n <= max_len).withColumns({"length": n, "truncated": F.lit(False)})
    if overlong != "truncate":
        raise ValueError(f"overlong: {overlong}")
    return df.withColumns({"truncated": n > max_len, "input_ids": F.slice("input_ids", 1, max_len), "labels": F.slice("labels", 1, max_len), "length": F.least(n, F.lit(max_len))})


def padded(df: DataFrame, batch: str, pad_id: int, multiple: int = 8) -> DataFrame:
    """df with ids, labels and ``attention_mask`` padded to the longest row of its batch, rounded up."""
    longest = df.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_m"))
    wide = df.join(longest, batch).withColumn("_m", (F.ceil(F.col("_m") / F.lit(float(multiple))) * multiple).cast("int"))
    fill = F.col("_m") - F.size("input_ids")
    return wide.withColumns({"attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), fill)), "input_ids": F.concat("input_ids", F.array_repeat(F.lit(pad_id), fill)), "labels": F.concat("labels", F.array_repeat(F.lit(IGNORED), fill))}).drop("_m")
