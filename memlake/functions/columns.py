"""Column expressions; all but `folded_tokens` stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from math import pi

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words, and their stretches of Chinese and Japanese characters or of others.
WORD = re.compile(r"[^\W_]+")
CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
RUN = re.compile("[\u3040-\u30ff\u3400-\u9fff]+|[^\u3040-\u30ff\u3400-\u9fff]+")

#: Seconds of a day and of a week.
DAY, WEEK = 86_400, 604_800
# The scales of the time code in seconds (minute to decade), and the bucket widths of a chart in minutes.
TIME_SCALES = (60, 3_600, DAY, WEEK, 30 * DAY, 365 * DAY, 3_650 * DAY)
BUCKET_MINUTES = (1, 2, 5, 10, 15, 30, 60, 120, 240, 360, 720, 1_440, 2_880, 4_320, 10_080, 20_160, 43_200, 86_400, 129_600, 259_200, 525_600)
# For stages 3, 2 and 1 the scopes (or all there are, if fewer), the share of the active scopes and the sessions that they take.
STAGES = ((3, 8, 0.78, 5), (2, 4, 0.55, 3), (1, 2, 0.25, 2))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a side is null or of length zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def bucket(ts: Column, width: int) -> Column:
    """The start of the bucket of `width` seconds that an epoch second lies in."""
    return F.floor(ts / F.lit(width)).cast("long") * F.lit(width)


def epoch(ts: Column) -> Column:
    """Epoch seconds of a timestamp, with or without zone; the session's zone is UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def normalised(text: Column) -> Column:
    """White space collapsed, trimmed, lower case: the key of exact duplicates."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f\v]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of Unicode letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))


def stem(token: Column) -> Column:
    """A light English stem: long words lose -ing (and a doubled letter before it), -ies becomes -y, a single final s goes."""
    n = F.length(token)
    return (
        F.when((n > 5) & token.endswith("ing"), F.regexp_replace(F.regexp_replace(token, "ing$", ""), r"^(.+)(.)\2$", "$1$2"))
        .when((n > 4) & token.endswith("ies"), F.regexp_replace(token, "ies$", "y"))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def scope_key(scope: Column) -> Column:
    """Spellings of one scope meet: lower case, no trailing slashes, runs of - and _ are one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(scope)), "/+$", ""), "[-_]+", "-")


def decayed(salience: Column, seconds: Column, life: float = WEEK, least: float = 0.01) -> Column:
    """Exponential decay that never falls below `least`."""
    return F.greatest(F.lit(least), salience * F.exp(-F.greatest(F.lit(0), seconds) / F.lit(float(life))))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def time_code(ts: Column) -> Column:
    """Sine and cosine of the time at each scale, scaled to length 1."""
    waves = [f(F.lit(2 * pi) * ts / F.lit(float(s))) / F.lit(len(TIME_SCALES) ** 0.5) for s in TIME_SCALES for f in (F.sin, F.cos)]
    return F.array(*waves)


def stage(scopes: Column, kinds: Column, sessions: Column, active: Column) -> Column:
    """How general a claim is, 0 to 3, from the scopes, scope kinds and sessions that it was used in and the number of active scopes.

    Two kinds or more make up for one session, but for stage 1.
    """
    share = F.round(scopes / F.greatest(F.lit(1), active), 4)
    bonus = F.when(kinds >= 2, 1).otherwise(0)
    out = F.lit(0)
    for name, least, breadth, seen in reversed(STAGES):
        enough = sessions + (bonus if name > 1 else F.lit(0)) >= seen
        out = F.when((scopes >= F.least(F.lit(least), active)) & (share >= breadth) & enough, name).otherwise(out)
    return out


def ladder(seconds: Column, most: int = 40) -> Column:
    """The narrowest bucket width, in seconds, that divides the window into at most `most` buckets, else the widest."""
    out = F.lit(BUCKET_MINUTES[-1] * 60)
    for minutes in reversed(BUCKET_MINUTES[:-1]):
        out = F.when(seconds <= minutes * 60 * most, minutes * 60).otherwise(out)
    return out


def facets(json: Column) -> Column:
    """A flat JSON object as a map of strings; null unless it is a valid object of at most 16 KiB."""
    found = F.try_variant_get(F.try_parse_json(json), "$", "map<string,string>")
    return F.when(F.octet_length(json) <= 16_384, found)


def compatible(a: Column, b: Column) -> Column:
    """Whether no key that both maps have differs in its value; a null map contradicts nothing."""
    clash = F.exists(F.map_keys(a), lambda k: F.coalesce(a[k] != b[k], F.lit(False)))
    return ~F.coalesce(clash, F.lit(False))


def meets(required: Column, current: Column) -> Column:
    """Whether the map `current` has every key of `required` (map of lists) with a value out of its list."""
    return F.forall(F.map_entries(required), lambda e: F.coalesce(F.array_contains(e["value"], current[e["key"]]), F.lit(False)))


def canonical_json(pairs: Column) -> Column:
    """A map of strings as compact JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def offset_time(text: Column) -> Column:
    """Epoch seconds of an RFC 3339 time with its offset; null if the offset or the format is missing."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(ok, F.unix_seconds(text.try_cast("timestamp")))


def elapsed_seconds(text: Column) -> Column:
    """Seconds of a process' elapsed time, [[dd-]hh:]mm:ss; null for other texts."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, r"^(?:(?:(\d+)-)?(\d+):)?(\d+):(\d+)$", i), F.lit("")).cast("long"), F.lit(0))
    return F.when(text.rlike(r"^((\d+-)?\d+:)?\d+:\d+$"), ((part(1) * 24 + part(2)) * 60 + part(3)) * 60 + part(4))


def identifiers(text: Column) -> Column:
    """Identifiers of two characters or more in order, each once, case kept: whole ones and the parts of compound ones (snake_case, camelCase)."""
    whole = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"))
    parts = lambda t: F.split(F.regexp_replace(F.regexp_replace(t, r"([\p{Ll}\p{N}])(\p{Lu})", "$1_$2"), "_+", "_"), "_")
    every = F.flatten(F.transform(whole, lambda t: F.concat(F.array(t), parts(t))))
    return F.array_distinct(F.filter(every, lambda t: F.length(t) >= 2))


@F.pandas_udf(ArrayType(StringType()))
def _folded(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[str] | None:
        if text is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
        found: set[str] = set()
        for word in WORD.findall(plain):
            for run in RUN.findall(word):
                found.update(run[i : i + 2] for i in range(len(run) - 1)) if CJK.match(run) and len(run) > 1 else found.add(run[:6])
        return sorted(found)

    return texts.map(one)


def folded_tokens(text: Column) -> Column:
    """Sorted distinct tokens that spellings of a word share: lower case, accents gone, the first six letters; pairs of characters of Chinese and Japanese."""
    return _folded(text)
