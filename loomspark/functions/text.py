"""Text functions as Column expressions.

Character classes are spelled out where Java's defaults are ASCII: ``SPACE`` is Unicode white space,
``WORD`` letters, numbers and the underscore. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and Python have it.
SPACE = r"[\t\n\x0B\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"
#: What may close a sentence, and the marks that may follow it.
_STOPS, _CLOSERS = ".!?…", "\"'”’»)\\]"
_MARK = "\u0001"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column) -> Column:
    """c, evaluated once a row. The optimizer copies costly expressions into every filter on them; it leaves those alone that a random number takes part in."""
    return F.when(F.rand(0) >= 0, c)


def strip(c) -> Column:
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+\\z", "")


def clean(c) -> Column:
    """CRLF and CR become LF, runs of blanks and tabs one space, three or more newlines two; stripped."""
    t = F.regexp_replace(_col(c), "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))


def full(parts: Column) -> Column:
    """Stripped pieces that are not empty."""
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def paragraphs(c) -> Column:
    return full(F.split(_col(c), "\n{2,}", -1))


def sentences(c) -> Column:
    """Pieces that end in a stop (and closing marks) before white space, and the tail."""
    marked = F.regexp_replace(_col(c), f"([{_STOPS}]+[{_CLOSERS}]*)(?={SPACE})", f"$1{_MARK}")
    return full(F.split(marked, _MARK, -1))


def words(c) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(f"{WORD}+"), F.lit(0))


def token_estimate(c, chars_per_token: float = 4.0, empty: int = 0) -> Column:
    """Characters over ``chars_per_token``, one at least; ``empty`` for the empty text (0 for curation, 1 for tagging)."""
    t = _col(c)
    return F.when(t == "", F.lit(empty)).otherwise(F.greatest(F.lit(1), F.floor(F.length(t) / F.lit(float(chars_per_token))))).cast("int")


def shingles(words_: Column, k: int = 5) -> Column:
    """Runs of k words joined by a space; all words in one, if fewer; none of none."""
    n = F.size(words_)
    many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.concat_ws(" ", F.slice(words_, i, k)))
    return F.when(n >= k, many).when(n > 0, F.array(F.concat_ws(" ", words_))).otherwise(F.array().cast("array<string>"))


def norm_label(c) -> Column:
    """Lower case; punctuation separates; runs of blanks and hyphens become one underscore; none at the ends."""
    t = F.regexp_replace(F.lower(strip(c)), rf"[^\p{{L}}\p{{N}}_{SPACE[1:-1]}\-]", " ")
    return F.regexp_replace(F.regexp_replace(t, rf"[{SPACE[1:-1]}\-]+", "_"), "^_+|_+\\z", "")


def slug(c) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_col(c), "[^a-zA-Z0-9._-]+", "-"), "^-+|-+\\z", ""))


def version_parts(c) -> Column:
    """The digits of the first three dotted parts as integers; a part without digits is 0."""
    digits = F.transform(F.slice(F.split(_col(c), "[.]"), 1, 3), lambda p: F.regexp_replace(p, "[^0-9]", ""))
    return F.transform(digits, lambda d: F.when(d == "", F.lit(0)).otherwise(d.try_cast("int")))


def percent(part, whole) -> Column:
    """Text such as 12.5%; 0.0% of nothing."""
    p, w = _col(part), _col(whole)
    return F.format_string("%.1f%%", F.when(w == 0, F.lit(0.0)).otherwise(F.lit(100.0) * p / w))


def duration(seconds) -> Column:
    """Seconds as 1h02m, 3m04s or 5s."""
    s = F.greatest(F.lit(0), _col(seconds).cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def rounded(c: Column, places: int) -> Column:
    """Half up, in plain double arithmetic, so that every engine gets the same number."""
    scale = F.lit(float(10**places))
    return F.floor(c * scale + F.lit(0.5)) / scale


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def marked(segments: Column, seams: bool) -> Column:
    """Cleaned segments that are not blank, joined by a blank line; with ``seams`` numbered marks between them."""
    segs = F.transform(F.filter(segments, lambda s: strip(s) != ""), clean)
    if not seams:
        return F.array_join(segs, "\n\n")
    return F.array_join(F.transform(segs, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit("\n\n⟦J"), i.cast("string"), F.lit("⟦\n\n"), s))), "")


def seam_offsets(segments: Column) -> Column:
    """Where each segment after the first begins in ``marked(segments, False)``."""
    lens = F.transform(F.filter(segments, lambda s: strip(s) != ""), lambda s: F.length(clean(s)))
    sums = F.aggregate(lens, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n + 2)))
    return F.when(F.size(sums) > 1, F.slice(sums, 1, F.size(sums) - 1)).otherwise(F.array().cast("array<int>"))


def unfound(entities: Column, source) -> Column:
    """Entities that the source doesn't hold, compared in lower case without blanks and quotes at the ends."""
    src = F.lower(_col(source))

    def probe(e):
        return F.lower(F.regexp_replace(strip(e), "^[\"']+|[\"']+\\z", ""))

    return F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: e.isNotNull() & (probe(e) != "") & ~F.contains(src, probe(e)))
