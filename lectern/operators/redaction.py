"""Scrubbing of hidden texts (SF36, SF37, JN13)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as X

PLACEHOLDER = "[redacted]"


def hidden_pattern(hidden: Column) -> Column:
    """A literal text as a pattern that ignores case and is flexible in white space."""
    quoted = X.sub(X.strip(hidden), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.concat(F.lit("(?iu)"), X.sub(quoted, r"(?U)\s+", r"(?U:\\s+)"))


def scrub(text: Column, hidden: Column) -> Column:
    """SF36: text with every text of the array (longest first) replaced."""
    order = F.transform(F.array_sort(F.transform(F.filter(hidden, lambda h: X.strip(h) != ""), lambda h: F.struct((-F.length(h)).alias("n"), h.alias("h")))), lambda s: s["h"])
    done = F.aggregate(order, text, lambda t, h: F.regexp_replace(t, hidden_pattern(h), F.lit(PLACEHOLDER)))
    return F.when(F.size(hidden) > 0, done).otherwise(text)


def scrub_json(json_text: Column, hidden: Column) -> Column:
    """SF37: every string value of a JSON text, at any depth, scrubbed; names, numbers and the shape stay. Text that is no JSON is scrubbed as text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, hiding: pd.Series) -> pd.Series:
        return pd.Series([_scrubbed(t, h) for t, h in zip(texts, hiding, strict=True)], dtype=object)

    return run(json_text, hidden)


def _scrubbed(text: str | None, hidden) -> str | None:
    words = sorted({h.strip() for h in (hidden if hidden is not None else []) if h and h.strip()}, key=lambda h: (-len(h), h))
    if text is None or not words:
        return text
    pattern = re.compile("|".join(r"\s+".join(map(re.escape, h.split())) for h in words), re.I)

    def walk(v):
        if isinstance(v, str):
            return pattern.sub(PLACEHOLDER, v)
        if isinstance(v, list):
            return [walk(x) for x in v]
        return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v

    try:
        return json.dumps(walk(json.loads(text)), ensure_ascii=False)
    except ValueError:
        return pattern.sub(PLACEHOLDER, text)


def leaks(text: Column, hidden: Column) -> Column:
    """JN13: whether a hidden text is still there, white space and case folded."""
    folded = F.lower(X.fold_space(text))
    return F.exists(hidden, lambda h: (X.strip(h) != "") & F.contains(folded, F.lower(X.fold_space(h))))
