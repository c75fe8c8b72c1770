"""Column functions shared by the operators. None reads a clock: the time is a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of the word tokeniser: everything but letters and digits.
WORD_BREAK = "[^\\p{L}\\p{N}]+"
#: The smallest denominator of a cosine: single-precision epsilon (fixed value).
EPSILON = 1.1920929e-07
DAY = 86_400
#: Seconds of the budget periods (fixed values); months are 30 days.
PERIODS = {"daily": DAY, "weekly": 7 * DAY, "monthly": 30 * DAY}


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda t: t != "")


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(EPSILON))


def decay(age: Column, half_life: float) -> Column:
    """2 ** (-age / half-life); ages below 0 count as 0, half-lives below a millisecond as one."""
    return F.pow(F.lit(2.0), -F.greatest(age.cast("double"), F.lit(0.0)) / max(half_life, 0.001))


def effective_importance(importance: Column, created: Column, now: float, half_life: float) -> Column:
    """Importance after decay since ``created`` (seconds); without a time: as old as can be."""
    return importance * decay(F.lit(now) - F.coalesce(created, F.lit(0)), half_life)


def utility(importance: Column, created: Column, recalls: Column, last_recall: Column, now: float, half_life: float) -> Column:
    """Effective importance, raised by recalls that fade at the same half-life."""
    base = effective_importance(importance, created, now, half_life)
    boost = F.coalesce(recalls, F.lit(0)) * decay(F.lit(now) - last_recall, half_life)
    return F.when(last_recall.isNull(), base).otherwise(base * (1 + boost))


def utc_day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def period_seconds(period: Column) -> Column:
    """Seconds of a named period; a number in text stands for itself."""
    out = period.try_cast("long")
    for name, seconds in PERIODS.items():
        out = F.when(period == name, seconds).otherwise(out)
    return out


def nearest_rank(q: float, n: Column) -> Column:
    """1-based rank of the q-quantile among n values: the rounded place, halves up."""
    return F.floor((n - 1) * F.lit(float(q)) + 0.5) + 1


def glob_regex(pattern: str) -> str:
    """A glob with ``*``, ``?`` and backslash escapes as an anchored regular expression."""
    out, i = ["^(?s)"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out) + "$"


def glob_match(value: Column, pattern: str) -> Column:
    return value.rlike(glob_regex(pattern))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without a zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def set_json_field(doc: Column, field: str, value: Column) -> Column:
    """A JSON object with ``field`` set to a JSON value, the other members as they were; anything but an object is left as it is."""
    members = F.from_json(doc, "map<string,variant>")
    merged = F.map_concat(F.map_filter(members, lambda k, _: k != field), F.create_map(F.lit(field), F.try_parse_json(value.cast("string"))))
    return F.when(F.ltrim(doc).startswith("{"), F.to_json(merged)).otherwise(doc)


def json_equal(a: Column, b: Column) -> Column:
    """Equality of JSON texts by value: members of objects in any order; null-safe."""
    plain = lambda x: F.to_json(F.try_parse_json(x))  # noqa: E731  variants keep object members sorted
    return F.coalesce(plain(a), a).eqNullSafe(F.coalesce(plain(b), b))
