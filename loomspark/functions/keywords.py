"""Keyword predicates: one compiled alternation, whole words, any case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import WORD, _col, ratio, rounded

_SPECIAL = re.compile(r"([\\\[\](){}.*+?^$|#\-&~ ])")


def _escaped(k: str) -> str:
    return _SPECIAL.sub(r"\\\1", k)


def pattern(keywords: list[str]) -> str:
    """Keywords in their order, not next to a word character on either side."""
    if not keywords:
        raise ValueError("no keywords")
    return f"(?iu)(?<!{WORD})(?:{'|'.join(map(_escaped, keywords))})(?!{WORD})"


def boundary_pattern(keywords: list[str]) -> str:
    """The same with word boundaries, which differ for keywords that begin or end in punctuation."""
    return rf"(?iuU)\b(?:{'|'.join(map(_escaped, keywords))})\b"


def matched(c, pattern_: str | None) -> Column:
    """Distinct matches in lower case."""
    if pattern_ is None:
        return F.array().cast("array<string>")
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(c), F.lit(pattern_), F.lit(0)), F.lower))


def hits(c, pattern_: str | None) -> Column:
    return F.size(matched(c, pattern_))


def density(hits_: Column, words_: Column) -> Column:
    return ratio(hits_, words_)


def share(hits_: Column, keywords: list[str]) -> Column:
    """Hits over the alternatives in the pattern: repeats count, and a bar within a keyword counts once more."""
    return hits_.cast("double") / F.lit(float("|".join(keywords).count("|") + 1))


def analysis(c, keywords: list[str], words_: Column) -> Column:
    m = matched(c, pattern(keywords))
    return F.struct(F.size(m).alias("hits"), rounded(density(F.size(m), words_), 5).alias("density"), rounded(share(F.size(m), keywords), 4).alias("ratio"), F.array_sort(m).alias("matched"))
