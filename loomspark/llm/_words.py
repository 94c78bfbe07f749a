"""White-space words of many texts at once, as codes into a table of distinct words."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from loomspark.llm._blocks import offsets_of


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of every word, offsets of each text in them, distinct words), split at runs of [\\x20\\x09-\\x0D]."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    off = offsets_of(lists).astype(np.int64)
    off = off - off[0]
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    blank = pc.index(words, "").as_py() if len(words) else -1
    if blank >= 0:  # texts that begin or end with white space
        keep = codes != blank
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        codes = codes[keep]
        codes = np.where(codes > blank, codes - 1, codes)
        words = pa.concat_arrays([words[:blank], words[blank + 1 :]])
    return codes, off, words


CHUNK, _BASES = 1 << 18, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@functools.lru_cache(2)
def powers(base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of one of two odd bases modulo 2**64, and of its inverse."""
    n = CHUNK + 1024
    up, down = np.full(n, _BASES[base], np.uint64), np.full(n, pow(_BASES[base], -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def hash64(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial in its bytes, from running sums over all of them, then mixed."""
    off, buf, (up, down) = offsets_of(words).astype(np.int64), words.buffers()[2], powers()
    out, i = np.zeros(len(words), np.uint64), 0
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    while i < len(words):
        j = int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1
        if j <= i:  # one very long string
            out[i] = xxhash.xxh3_64_intdigest(data[off[i] : off[i + 1]].tobytes())
            i += 1
            continue
        sums = np.zeros(int(off[j] - off[i]) + 1, np.uint64)
        np.cumsum((data[off[i] : off[j]].astype(np.uint64) + np.uint64(1)) * up[: len(sums) - 1], out=sums[1:])
        o = off[i : j + 1] - off[i]
        out[i:j] = mixed((sums[o[1:]] - sums[o[:-1]]) * down[o[:-1]] ^ (np.diff(o).astype(np.uint64) << np.uint64(40)))
        i = j
    return out


def hash128(words: pa.Array) -> list[bytes]:
    h = xxhash.xxh3_128_digest
    return [h(w) for w in words.cast(pa.binary()).to_pylist()]


def split_by(owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): positions grouped by owner, and where each owner's positions begin."""
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(owners + 1))


def fold(h: np.ndarray) -> int:
    """A fingerprint of a set of hashes, as a signed 63-bit integer."""
    return int(np.bitwise_xor.reduce(h, initial=np.uint64(len(h))) >> np.uint64(1))
