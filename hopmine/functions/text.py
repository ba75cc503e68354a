"""Text and JSON expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that Python's strip() takes off.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unfenced(text: Column) -> Column:
    """A stripped text without the code fence around it, if it begins with one."""
    opened = F.regexp_replace(text, r"^```(?:json)?\s*", "")
    bare = let(opened, lambda t: F.when(t.endswith("```"), F.rtrim(F.left(t, F.char_length(t) - 3), F.lit(BLANK))).otherwise(t))
    return F.when(text.startswith("```"), bare).otherwise(text)


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer, as text: without a code fence, else from the first { to the last }; null if there is none.

    An answer that is JSON of another kind, such as an array, has none. Every step is computed once a row, and braces are
    looked for only where the whole answer is no JSON.
    """
    valid = lambda c: F.get_json_object(c, "$").isNotNull()

    def inner(t: Column) -> Column:
        start = F.locate("{", t)
        stop = F.char_length(t) - F.char_length(F.substring_index(t, "}", -1))
        return let(F.when((start > 0) & (stop > start), F.substring(t, start, stop - start + 1)), lambda c: F.when(valid(c), c))

    def found(t: Column) -> Column:
        other = (t.startswith("[") | t.startswith('"')) & valid(t)
        return F.when(t.startswith("{") & valid(t), t).when(~other, inner(t))

    return let(let(strip(text), _unfenced), found)


def word_set(text: Column) -> Column:
    """The distinct words of a text, case-folded."""
    return F.array_distinct(F.regexp_extract_all(casefold(text), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays without repeats; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


_ARTICLES = re.compile(r"\b(?:a|an|the)\b")


def _normal(text: str | None) -> str | None:
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    plain = "".join(c if c.isalnum() or c.isspace() or c == "_" else " " for c in plain)
    return " ".join(_ARTICLES.sub(" ", plain).split())


@F.pandas_udf(T.StringType())
def normal_answer(text: pd.Series) -> pd.Series:
    """Answers for comparison: compatibility-decomposed, no accents, case or punctuation, no articles, single spaces."""
    return text.map(_normal)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normal_answers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: None if ts is None else [_normal(t) for t in ts])


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())
