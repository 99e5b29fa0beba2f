"""Column builders for the scalar functions of the memory model. All stay in the JVM but hmac_sha256()."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notegraph.schemas import NOTE_KINDS

LETTERS = r"[^\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once and bound to a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; null where lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - F.when(norm > 0, dot(a, b) / norm)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), LETTERS), lambda t: t != "")


def joined(values: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(values, F.array().cast("array<string>")))


def token_estimate(text: Column) -> Column:
    """0 for an empty text, else the ceiling of length / 3.8, at least 1."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(3.8)).cast("int"))).cast("long")


def decay(score: Column, age_days: Column, half_life: float = 30.0, least: float = 0.05) -> Column:
    """score times an exponential of its age, not under least. A missing age leaves it."""
    rate = F.lit(0.6931471805599453 / max(0.001, half_life))
    factor = F.greatest(F.lit(least), F.exp(-rate * F.greatest(F.lit(0.0), age_days)))
    return score * F.coalesce(factor, F.lit(1.0))


def slug(text: Column) -> Column:
    """File-name form of a note: 40 characters at most, in lower case; letters and digits of any script stay, spaces (no other white space) and -_ become single dashes."""
    kept = F.regexp_replace(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 40)), r"[^\p{L}\p{Nd} _-]", "")
    made = F.regexp_replace(F.regexp_replace(kept, r"[ _-]+", "-"), r"^-+|-+$", "")
    return F.when(made == "", F.lit("note")).otherwise(made)


def tenant_slug(text: Column) -> Column:
    """Each character that is neither letter nor digit becomes a dash; dashes at the ends go."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "-"), r"^-+|-+$", "")


def yaml_value(text: Column) -> Column:
    """Quoted, with backslashes and quotes escaped, where text holds a colon, a hash or a line end."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(text.rlike("[:#\n]"), quoted).otherwise(text)


def frontmatter(text: Column) -> Column:
    """What stands between the leading --- and the next line that begins with ---; null without one."""
    found = F.regexp_extract(text, r"\A---(?s:(.*?))\n---", 1)
    return F.when(text.rlike(r"\A---(?s:.*?)\n---"), F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")))


def body(text: Column) -> Column:
    """The text after its front matter, or the whole of it, trimmed."""
    rest = F.regexp_replace(text, r"\A---(?s:.*?)\n---", "")
    return F.regexp_replace(rest, r"^\s+|\s+$", "")


def markdown(note_id: Column, kind: Column, created: Column, tags: Column, keywords: Column, context: Column, content: Column) -> Column:
    """A note as a document with front matter; empty tags, keywords and context are left out."""
    listed = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}: ["), F.concat_ws(", ", xs), F.lit("]")))
    lines = [F.lit("---"), F.concat(F.lit("id: "), note_id), F.concat(F.lit("kind: "), kind), F.concat(F.lit("created: "), iso(created)), listed("tags", tags), listed("keywords", keywords)]
    lines += [F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("context: "), yaml_value(context))), F.lit("---"), F.lit(""), content]
    return F.concat_ws("\n", *lines)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def file_name(created: Column, kind: Column, content: Column, note_id: Column) -> Column:
    return F.concat(F.date_format(created, "yyyy-MM-dd"), F.lit("_"), F.lower(kind), F.lit("_"), slug(content), F.lit("_"), short_id(note_id), F.lit(".md"))


def short_id(uuid: Column) -> Column:
    return F.substring(F.replace(uuid, F.lit("-"), F.lit("")), 1, 8)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def kind_name(code: Column) -> Column:
    """The kind's name; null for a code out of range."""
    return F.get(F.array(*map(F.lit, NOTE_KINDS)), code.cast("int"))


def kind_code(name: Column) -> Column:
    """The kind's code, in any case; null for an unknown name."""
    at = F.array_position(F.array(*(F.lit(k.upper()) for k in NOTE_KINDS)), F.upper(F.trim(name)))
    return F.when(at > 0, (at - 1).cast("int"))


def is_uuid(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def key_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def bearer(header: Column) -> Column:
    """The token of an authorization header; null when blank or of another scheme."""
    found = F.trim(F.regexp_extract(header, r"^(?i:bearer) +(.*)$", 1))
    return F.when(found != "", found)


def string_map(json: Column) -> Column:
    """A JSON object as map of strings: scalars as text, nested values as JSON text, null as an empty one."""
    parsed = F.from_json(json, "map<string,string>")
    return F.transform_values(parsed, lambda _, v: F.coalesce(v, F.lit("")))


def split_tags(text: Column) -> Column:
    """Comma-separated tags, trimmed, in lower case, distinct and not blank."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def end_of_day(day: Column) -> Column:
    return F.to_timestamp(F.date_add(day, 1)) - F.expr("interval 1 microsecond")


@F.pandas_udf(StringType())
def hmac_sha256(secret: pd.Series, message: pd.Series) -> pd.Series:
    """Lower-case hex; the JVM has no such function for columns."""
    import hashlib
    import hmac

    sign = lambda k, m: None if k is None or m is None else hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest()
    return pd.Series([sign(k, m) for k, m in zip(secret, message, strict=True)])
