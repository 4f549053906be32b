"""Scalar functions as Column builders; Arrow functions only where Spark has none."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


@pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding (ß becomes ss); null stays null."""
    return s.map(lambda x: None if x is None else x.casefold())


def _no_json(word: str) -> None:
    raise ValueError(word)


def _canonical(x: str | None) -> str | None:
    if x is None:
        return None
    try:
        return json.dumps(json.loads(x, parse_constant=_no_json), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, UTF-8, numbers as written (1.0 stays 1.0); null if it isn't JSON."""
    return s.map(_canonical)


@pandas_udf(T.DoubleType())
def round6(s: pd.Series) -> pd.Series:
    """Rounded to 6 places half-even on the binary value."""
    return s.map(lambda x: None if pd.isna(x) else round(float(x), 6))


def field_key(c: Column | str) -> Column:
    """The identity token of a field reference: NFKC, trimmed, lower case, runs of
    white space, dashes, dots and slashes become one underscore; null if empty."""
    t = F.lower(F.regexp_replace(nfkc(F.col(c) if isinstance(c, str) else c), r"^[\s 　]+|[\s 　]+$", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"[\s 　\-./]+", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.when(t != "", t)


def ascii_key(c: Column) -> Column:
    """field_key of a value known to be ASCII, without leaving the JVM."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-./]+", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.when(t != "", t)


def json_sha(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def contains_ci(c: Column, needle: str) -> Column:
    """LIKE '%needle%' that folds ASCII only; % and _ in the needle stay wildcards."""
    return ascii_lower(c).like(f"%{needle.translate(str.maketrans(_UPPER, _LOWER))}%")


def pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def label_of_key(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def json_kind(c: Column) -> Column:
    """object, array, text, integer, number, boolean, null; null if it isn't JSON.
    Booleans are told before integers."""
    s = F.schema_of_variant(F.try_parse_json(c))
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "text").when(s == "BOOLEAN", "boolean")
            .when(s == "VOID", "null").when(s == "BIGINT", "integer").when(s.isNotNull(), F.when(F.trim(c).rlike(r"^-?\d+$"), "integer").otherwise("number")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def digest_id(n: int, *parts: Column) -> Column:
    """First n hex digits of the SHA-256 of the parts, separated by a unit mark."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, n)


def text_of_value(c: Column) -> Column:
    """A JSON value as a group key: strings bare, True, False and None by name."""
    bare = F.get_json_object(c, "$")
    return F.when(c == "true", "True").when(c == "false", "False").when(c == "null", "None").otherwise(F.coalesce(bare, c))


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters as a 0-based number (A 0, Z 25, AA 26)."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(acc * 26 + F.ascii(ch) - 64)) - 1


# Media classes by file extension; any other is binary.
MEDIA = {
    "text": "md txt rst",
    "data": "json jsonl csv tsv",
    "source": "py js mjs ts tsx rs go lean css html",
    "archive": "zip tar gz 7z",
    "image": "png jpg jpeg gif svg",
    "document": "pdf docx",
}
# Programming languages by file extension.
LANGUAGES = {"py": "Python", "js": "JavaScript", "mjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "rs": "Rust", "go": "Go", "lean": "Lean", "css": "CSS", "html": "HTML"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_class(path: Column) -> Column:
    e = extension(path)
    return F.coalesce(*[F.when(e.isin(v.split()), F.lit(k)) for k, v in MEDIA.items()], F.lit("binary"))


def programming_language(path: Column) -> Column:
    """By extension; null for what is no source."""
    e = extension(path)
    return F.coalesce(*[F.when(e == k, F.lit(v)) for k, v in LANGUAGES.items()])


def is_language_tag(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$")


def safe_segment(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def mentions(text: Column, names: Column) -> Column:
    """How many of the names (two characters or more) stand in the text."""
    return F.size(F.filter(names, lambda n: (F.length(n) >= 2) & F.contains(text, n)))


def parse_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1", "yes"), F.lit(True)).when(t.isin("false", "0", "no"), F.lit(False))


def parse_int(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def is_hex64(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def name_key(c: Column) -> Column:
    """A name for identity grouping: NFKC, folded, inner white space as one space."""
    return F.trim(F.regexp_replace(casefold(nfkc(c)), r"\s+", " "))


def age_days(then: Column, now: Column) -> Column:
    """Days between two instants, with fractions; null if either is."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86_400_000_000.0)


def strictly_after(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, F.lit(False))


def canonical_instant(c: Column) -> Column:
    """An ISO text with a zone as UTC with microseconds and Z; null without a zone."""
    zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def in_zone(c: Column, zone: str) -> Column:
    """UTC instant as local time of a named zone or fixed offset."""
    return F.from_utc_timestamp(c, zone)


# Shapes of well-known secrets.
SECRET_SHAPES = (
    r"\bsk-[A-Za-z0-9_\-]{16,}",
    r"\bgh[pousr]_[A-Za-z0-9]{16,}",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    r"\bAKIA[0-9A-Z]{16}",
    r"\bAIza[0-9A-Za-z_\-]{35}",
    r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
# Least length of a bare token, most separators in it, and the names of
# fields that may hold such runs (but no well-known shape).
TOKEN_LENGTH, TOKEN_SEPARATORS = 28, 3
TOLERANT = ("borrower_session", "notes", "consumers")


def known_secret(c: Column) -> Column:
    return c.rlike("|".join(SECRET_SHAPES))


def bare_token(c: Column) -> Column:
    """An unbroken run of so many letters and digits, or one with few dashes and
    underscores that has both cases and a digit."""
    runs = F.regexp_extract_all(c, F.lit(rf"(?<![\w/.])([A-Za-z0-9_\-]{{{TOKEN_LENGTH},}})(?!\w)"), 1)
    mixed = F.exists(runs, lambda r: (F.length(F.regexp_replace(r, "[^-_]", "")) <= TOKEN_SEPARATORS) & r.rlike("[a-z]") & r.rlike("[A-Z]") & r.rlike("[0-9]"))
    return c.rlike(f"[A-Za-z0-9]{{{TOKEN_LENGTH},}}") | mixed


def looks_secret(c: Column, field: Column | None = None) -> Column:
    """A known shape, or a bare token unless the field's name allows those; null is
    none."""
    bare = bare_token(c) if field is None else bare_token(c) & ~F.coalesce(field.isin(*TOLERANT), F.lit(False))
    return F.coalesce(known_secret(c) | bare, F.lit(False))
