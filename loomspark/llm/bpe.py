"""Byte-pair encoding and decoding through a table of distinct words (word_bpe_49k.json and alike).

The tokenizer drops white space, so the ids of a text are the ids of its white-space words, in
order, and no rule of it looks across [\\x20\\x09-\\x0D]. Each block of texts is split into words;
its distinct words go to their owners by hash; an owner encodes each distinct word once, however
many blocks hold it. The ids return to the blocks, where they are joined to the words by position,
and there they are decoded by a join with the table of pieces by id: a gather, as the table, of the
tokenizer's fixed size, is in every worker.

Null and empty texts: no ids, and the hash of the empty string. Repeated rows and ids each give
their row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomspark.llm import _blocks as B
from loomspark.llm._words import fold, hash64, split_by, word_codes

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: A word of Latin letters that lower-case one to one and are composed already, then plain punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!\"#$%&()*+,\-./:;=?@]*)\Z")


class WordEncoder:
    """Ids of single words, as Tokenizer.encode(add_special_tokens=False) gives them.

    Plain words go through the merges in long runs, without the normalizer, whose outcome for
    them is known; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.whole.get_vocab_size()
        self.pieces = pa.array([self.whole.id_to_token(i) or "" for i in range(size)], pa.string())
        self.ends = np.array([(p or "").endswith("</w>") for p in self.pieces.to_pylist()])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words after one another, number of ids of each word)."""
        parts, spans, odd = [], np.zeros(len(words), np.int64), []
        for i, w in enumerate(words):
            if m := _PLAIN.match(w):
                a, b = m.groups()
                if a:
                    parts.append(a.lower())
                if b:
                    parts.append(b)
                spans[i] = bool(a) + bool(b)
            else:
                odd.append(i)
        runs = self.merges.encode_batch_fast([" ".join(parts[i : i + 400]) for i in range(0, len(parts), 400)], add_special_tokens=False)
        ids = np.concatenate([np.array(r.ids, np.int32) for r in runs]) if runs else np.empty(0, np.int32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(parts):
            raise RuntimeError("a plain word did not end in exactly one word-end piece")
        stop = np.concatenate([[0], last])[np.cumsum(spans)]
        counts = np.diff(stop, prepend=0)
        if not odd:
            return ids, counts
        rows = [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)]
        more = dict(zip(odd, rows))
        out, at = [], 0
        for i in odd:
            out += [ids[at : stop[i]], more[i]]
            at = stop[i]
        counts[odd] = [len(r) for r in rows]
        return np.concatenate([*out, ids[at:]]), counts


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def gather(codes: np.ndarray, ids: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every word by position, and the bounds of each text in them."""
    start = np.cumsum(counts) - counts
    n = counts[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(start[codes] - (ends - n), n)
    return ids[at], np.concatenate([[0], ends])[bounds]


def encoded(docs: DataFrame, tokenizer: str, rows, schema: str) -> DataFrame:
    """Encode every text and make rows of the ids.

    rows(doc_ids, batches, block) -> pa.Table, where batches yields (ids of some texts after one
    another, bounds of each text in them).
    """

    def keys(ids, texts, owners):
        _, _, words = word_codes(texts)
        h = hash64(words)
        order, at = split_by(h % np.uint64(owners), owners)
        words = words.take(pa.array(order))
        raw = [("\n".join(words[i:j].to_pylist())).encode() for i, j in zip(at, at[1:])]
        return [(p, B.pack(raw[p])) for p in range(owners) if at[p] < at[p + 1]], fold(h)

    def answer(asked):
        enc = encoder(tokenizer)
        lists = [B.unpack(blob)[0].decode().split("\n") for _, blob in asked]
        coded = pa.chunked_array([pa.array(x, pa.string()) for x in lists]).combine_chunks().dictionary_encode()
        ids, counts = enc.encode(coded.dictionary.to_pylist())
        codes, at = coded.indices.to_numpy(), 0
        for (block, _), words in zip(asked, lists):
            c = codes[at : at + len(words)]
            at += len(words)
            mine, _ = gather(c, ids, counts, np.zeros(1, np.int64))
            yield block, B.pack(counts[c].astype(np.uint16 if len(c) == 0 or counts[c].max() < 65536 else np.uint32), mine.astype(np.uint16 if len(enc.pieces) <= 65536 else np.uint32))

    def finish(doc_ids, texts, answers, owners, block):
        codes, off, words = word_codes(texts)
        order, at = split_by(hash64(words) % np.uint64(owners), owners)
        got = [B.unpack(answers[p]) for p in range(owners) if at[p] < at[p + 1]]
        counts = np.concatenate([g[0] for g in got]).astype(np.int64) if got else np.empty(0, np.int64)
        flat = np.concatenate([g[1] for g in got]) if got else np.empty(0, np.uint16)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))

        def batches():
            for i in range(0, len(doc_ids), 500):  # few texts at a time: the ids of all would be large
                o = off[i : i + 501]
                yield gather(place[codes[o[0] : o[-1]]], flat, counts, o - o[0])

        return rows(doc_ids, batches(), block)

    return B.exchange(docs, keys, answer, finish, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: the number of ids, and hashes of the ids and of the text decoded from them."""

    def rows(doc_ids, batches, _block):
        pieces = encoder(tokenizer).pieces
        n, one, two = [np.empty(0, np.int64)], [], []
        for ids, ends in batches:
            n.append(np.diff(ends))
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            one += [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:])]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces.take(pa.array(ids))), " ")
            two += [hashlib.sha256(x).hexdigest() for x in texts.cast(pa.binary()).to_pylist()]
        return B.table(SCHEMA, doc_ids, np.concatenate(n), one, two)

    return encoded(docs, tokenizer, rows, SCHEMA)
