"""Scalar rules as column expressions. All parses are total: bad input gives NULL, never an error."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V

REDACTED = "[redacted]"
MAX_TEXT, MAX_DEPTH = 2048, 6
# A key that contains one of these is sensitive.
SENSITIVE = ["authorization", "auth", "password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "credential", "cookie", "session", "private", "signature", "otp", "code_verifier", "refresh"]
ECHOES = ["input", "value", "ctx"]
# Markers, and the patterns of tokens inside texts.
TRUNCATED, TOO_DEEP = "…[truncated]", "[max-depth]"
BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._\-]+"
JWT = r"\beyJ[A-Za-z0-9._\-]{20,}"


def as_int(c: Column) -> Column:
    """Deviates from a general-purpose parser on ``1_000``, other scripts' digits and values beyond 32 bits: NULL."""
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c.try_cast("int"))


def as_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def is_tracked(c: Column) -> Column:
    return ~F.lower(V.strip(c)).isin("0", "false", "no")


def alt_text(name: Column, set_name: Column, rarity: Column) -> Column:
    """``name — set rarity``; what is missing is left out."""
    return F.concat_ws(" — ", name, F.nullif(F.concat_ws(" ", set_name, F.translate(rarity, "_", " ")), F.lit("")))


def ratio(owned: Column, declared: Column) -> Column:
    """Uncapped; 0.0 for a set declared with no cards."""
    return F.when(declared != 0, owned.cast("double") / declared.cast("double")).otherwise(F.lit(0.0))


def percent_label(r: Column) -> Column:
    clamped = F.greatest(F.least(r, F.lit(1.0)), F.lit(0.0))
    return F.coalesce(F.concat(F.round(clamped * 100).cast("int").cast("string"), F.lit("%")), F.lit("—"))


def staleness(last_success: Column, now: Column, ageing_hours: int = 48, stale_hours: int = 168) -> tuple[Column, Column]:
    """(age in hours, state)."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(last_success)) / 3.6e9)
    state = F.when(last_success.isNull(), "never_run").when(age >= stale_hours, "stale").when(age >= ageing_hours, "ageing")
    return F.when(last_success.isNotNull(), F.bround(age, 2)), state.otherwise("fresh")


def scrub_text(c: Column) -> Column:
    # a plain look for a pattern's fixed letters costs a small part of the pattern, and most texts have none; each step
    # takes the text as one value, else every use of it would make it anew
    steps = [
        lambda t: F.when(F.contains(F.lower(t), F.lit("bearer")), F.regexp_replace(t, BEARER, f"Bearer {REDACTED}")).otherwise(t),
        lambda t: F.when(F.contains(t, F.lit("eyJ")), F.regexp_replace(t, JWT, REDACTED)).otherwise(t),
        lambda t: F.when(F.length(t) > MAX_TEXT, F.concat(F.substring(t, 1, MAX_TEXT), F.lit(TRUNCATED))).otherwise(t),
    ]
    return reduce(F.transform, steps, F.array(c))[0]


def is_sensitive(key: Column) -> Column:
    k = F.lower(key)
    found = F.lit(False)
    for part in SENSITIVE:
        found = found | k.contains(part)
    return found


def redact_flat(context: Column) -> Column:
    """A map<string,string> with sensitive values replaced and texts scrubbed."""
    return F.transform_values(context, lambda k, v: F.when(is_sensitive(k), F.lit(REDACTED)).otherwise(scrub_text(v)))


def _scrubbed(text: str) -> str:
    text = re.sub(JWT, REDACTED, re.sub(BEARER, f"Bearer {REDACTED}", text))
    return text if len(text) <= MAX_TEXT else text[:MAX_TEXT] + TRUNCATED


def _hides(key) -> bool:
    name = str(key).lower()
    return any(part in name for part in SENSITIVE)


def _redacted(document):
    """A copy of parsed JSON with sensitive values replaced. Places wait on a list, so no nesting is too deep to walk."""
    result = [None]
    waiting = [(result, 0, document, 0)]
    while waiting:
        target, place, found, depth = waiting.pop()
        if depth > MAX_DEPTH:
            target[place] = TOO_DEEP
        elif isinstance(found, str):
            target[place] = _scrubbed(found)
        elif isinstance(found, list):
            target[place] = [None] * len(found)
            waiting += [(target[place], i, inner, depth + 1) for i, inner in enumerate(found)]
        elif isinstance(found, dict):
            # a validation error repeats the input at a sensitive location under other names
            where = found.get("loc")
            secret = {k for k in found if _hides(k)}
            if isinstance(where, list) and any(_hides(step) for step in where):
                secret.update(k for k in ECHOES if k in found)
            target[place] = {k: REDACTED for k in found}
            waiting += [(target[place], k, inner, depth + 1) for k, inner in found.items() if k not in secret]
        else:
            target[place] = found
    return result[0]


@F.pandas_udf(StringType())
def redact_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Nested JSON text redacted to any depth; text that is no JSON, or nested too deep to read, is scrubbed as a string."""

    def one(text):
        if text is None:
            return None
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return _scrubbed(text)
        return json.dumps(_redacted(value), ensure_ascii=False, separators=(",", ":"))

    for s in batches:
        yield s.map(one)


def strip_query(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def request_severity(status: Column) -> tuple[Column, Column]:
    """(level, category)."""
    level = F.when(status.isin(401, 403), "warning").when(status >= 500, "error").otherwise("info")
    return level, F.when(status.isin(401, 403), "security").otherwise("http")


def known_level(level: Column) -> Column:
    return F.when(level.isin(V.LEVELS), level).otherwise("info")


def forwarded(level: Column, category: Column) -> Column:
    return F.coalesce(level.isin("error", "critical"), F.lit(False)) | F.coalesce(category == "security", F.lit(False))


def handle(c: Column) -> Column:
    h = F.lower(F.trim(c))
    return F.when(h.rlike("^[a-z0-9_]{3,32}$"), h)


def currency(c: Column) -> Column:
    return F.when(F.upper(c).rlike("^[A-Z]{3}$"), F.upper(c))


def merge_key(condition: Column, graded: Column) -> Column:
    """NULL for a graded copy: it never merges."""
    return F.when(~graded, condition)


def csv_safe(c: Column) -> Column:
    """A quote before values that a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def cursor_of(offset: Column) -> Column:
    """URL-safe base64 of the offset."""
    return F.translate(F.base64(offset.cast("string").cast("binary")), "+/", "-_")


def offset_of(cursor: Column) -> Column:
    """The offset of a cursor, NULL if malformed."""
    text = F.expr("1") if cursor is None else F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64")).cast("string")
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def spirit_cost(c: Column) -> tuple[Column, Column]:
    """(costs by element, whether the value is valid). Blank is valid and NULL."""
    raw = V.blank_to_null(c)
    entries = F.map_entries(F.from_json(raw, "map<string,bigint>"))
    bad = F.exists(entries, lambda e: V.element(e["key"]).isNull() | e["value"].isNull() | (e["value"] < 0))
    valid = raw.isNull() | (raw.startswith("{") & entries.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    # of keys that fold to one element the last counts
    folded = F.transform(entries, lambda e: F.struct(V.element(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(folded, lambda e, i: ~F.exists(F.slice(folded, i + 2, F.size(folded)), lambda x: x["key"] == e["key"]))
    return F.when(valid & raw.isNotNull(), F.map_from_entries(F.array_sort(last))), valid


def fingerprint(version: str, *columns: Column) -> Column:
    """sha256 over all fields, NULLs included, and a version; maps must come as sorted entries."""
    fields = [F.lit(version).alias("v"), *(c.alias(f"c{i}") for i, c in enumerate(columns))]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
