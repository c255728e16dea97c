"""Text: byte lengths and slices, patterns, formatting and Python's forms of values."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def len_bytes(s: Column) -> Column:
    """Bytes of the UTF-8 form."""
    return F.octet_length(s)


def substr_bytes(s: Column, start: int, stop: int | None = None) -> Column:
    """A slice by Python's rules, counted in bytes; a cut character becomes U+FFFD."""
    b, n = F.encode(s, "UTF-8"), F.octet_length(s)
    end = lambda i: F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))
    lo, hi = end(start), n if stop is None else end(stop)
    return F.make_valid_utf8(F.substring(b, lo + 1, F.greatest(hi - lo, F.lit(0))).cast("string"))


def replace(s: Column, pattern: str, by: str) -> Column:
    r"""All matches of a pattern; groups are written \1 or \g<name>."""
    by = by.replace("$", r"\$")
    by = re.sub(r"\\g<(\w+)>", lambda m: f"${{{m[1]}}}" if not m[1].isdigit() else f"${m[1]}", by)
    return F.regexp_replace(s, pattern, re.sub(r"\\(\d)", r"$\1", by))


def join(separator: str, *parts: Column) -> Column:
    """Null if a part is null, unlike Spark's own."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(separator), p)
    return out


@F.pandas_udf(T.StringType())
def _repr(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else repr(float(v)))


def str_(c: Column, kind: str) -> Column:
    """Python's text of a value: True and False, and the shortest digits of a float.
    A null is null; a float NaN that comes from Spark is `nan`."""
    if kind in ("boolean", "bool"):
        return F.when(c, "True").when(~c, "False")
    if kind in ("double", "float"):
        return F.when(F.isnan(c), "nan").when(c.isNotNull(), _repr(c))
    return c.cast("string")


def _simple(template: str) -> list[tuple[str, str | None]] | None:
    """Literal parts and field names, if no field has a format or conversion."""
    parts, free = [], 0
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if spec or conversion or (name and not (name.isdigit() or name.isidentifier())):
            return None
        if name == "":
            name, free = str(free), free + 1
        parts.append((literal, name))
    return parts


def format_(template: str, *args: Column, strict: bool = True, **named: Column) -> Column:
    """Python's formatting.  Fields without a format are joined in the JVM (give
    texts, whole numbers, or floats through `str_`); others are formatted in Arrow
    batches.  A null field makes the result null, or reads None unless `strict`."""
    values = {str(i): c for i, c in enumerate(args)} | named
    ready = F.lit(True)
    for c in values.values():
        ready = ready & c.isNotNull()
    parts = _simple(template)
    if parts is not None:
        pieces = []
        for literal, name in parts:
            pieces.append(F.lit(literal))
            if name is not None:
                pieces.append(F.coalesce(values[name].cast("string"), F.lit("None")))
        whole = F.concat(*pieces) if pieces else F.lit("")
        return F.when(ready, whole) if strict else whole
    n, names = len(args), list(named)

    @F.pandas_udf("string")
    def run(x: pd.DataFrame) -> pd.Series:
        columns = [x[c].astype(object).where(x[c].notna(), None) for c in x.columns]
        return pd.Series([None if strict and any(v is None for v in r) else template.format(*r[:n], **dict(zip(names, r[n:], strict=True))) for r in zip(*columns, strict=True)], dtype=object)

    return run(F.struct(*[c.alias(f"f{i}") for i, c in enumerate(values.values())]))
