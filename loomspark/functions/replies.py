"""Replies of a language model as JSON: the first balanced object, repaired where it is cut off.

Balancing braces outside strings needs a scan with state, which no built-in function has; it runs in
Arrow batches. The result is JSON text, for from_json() with a schema; NULL where nothing parses.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

#: The fence around a reply, and the repairs of a cut one, in their order.
_FENCE = re.compile(r"\A```[a-zA-Z]*\n?|\n?```\Z")
_REPAIRS = ((r",\s*,", ","), (r",\s*,", ","), (r",\s*([}\]])", r"\1"))
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def first_object(reply: str | None) -> str | None:
    """The first balanced {...} of a reply, if it is JSON. A code fence around the reply is dropped."""
    if reply is None:
        return None
    s = reply.strip()
    if s.startswith("```"):
        s = _FENCE.sub("", s).strip()
    begin, depth = s.find("{"), 0
    if begin < 0:
        return None
    for m in _TOKEN.finditer(s, begin):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth and m.group() == "}":
            try:
                json.loads(s[begin : m.end()])
            except ValueError:
                return None
            return s[begin : m.end()]
    return None


def repaired(reply: str | None) -> str | None:
    """first_object(), or the reply from its first brace with doubled and trailing commas dropped and open brackets closed."""
    if reply is None or (found := first_object(reply)) is not None:
        return None if reply is None else found
    if "{" not in reply:
        return None
    s = reply[reply.index("{") :]
    for old, new in _REPAIRS:
        s = re.sub(old, new, s)
    for left, right in ("[]", "{}"):
        s += right * (s.count(left) - s.count(right))
    try:
        json.loads(s)
    except ValueError:
        return None
    return s


def extract_json(c):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(first_object)

    return run(c)


def parse_json(c):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(repaired)

    return run(c)


def facets(reply):
    """A map of lists from a reply: a scalar facet is a list of one, and what holds no text (numbers, objects, null) is left out. Null where the reply is no object."""
    each = F.from_json(reply, "map<string,string>")
    quoted = F.transform_values(each, lambda k, v: F.when(F.trim(v).startswith("["), F.filter(F.from_json(v, "array<string>"), lambda x: x.isNotNull())).when(v.rlike(r"^\s*(\{|-?[0-9.]+([eE][-+]?[0-9]+)?\s*$|true$|false$)"), F.lit(None)).otherwise(F.array(v)))
    return F.map_filter(quoted, lambda k, v: v.isNotNull())
