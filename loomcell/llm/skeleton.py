"""Visually identical text: confusables skeletons, and groups and pairs by them.

A skeleton is made by decomposing a text, replacing every character by the
prototype of its look-alikes, and decomposing again; texts that look the same have
the same skeleton. Case, accents, digits against letters and superscripts stay
apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcell.runtime import lookup_join, ship, spool

# Cyrillic and Greek letters drawn like Latin ones.
_LETTERS = (
    ("аеорсухіјѕһԁԛԝѵӏүоϲϳον", "aeopcyxijshdqwvlyocjov"),
    ("αικρυ", "aikpu"),
    ("АВЕКМНОРСТУХІЈЅԚԜԌѴҮӀ", "ABEKMHOPCTYXIJSQWGVYI"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
)
# Radicals of the supplement block and the ideographs drawn like them.
_RADICALS = (
    "⺁⺂⺃⺄⺅⺆⺈⺉⺊⺋⺌⺍⺎⺏⺐⺒⺓⺔⺖⺗⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺹⺺⺻⺼⺽⺾⺿⻀⻂⻃⻄⻅⻆⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻰",
    "厂乛乚乙亻冂刀刂卜㔾小小兀尣尢巳幺彑忄㣺扌攵旡日月歺民氵氺灬爫爫丬牛犭王疋目示礻竹糹纟罓罒耂肀聿肉臼艹艹艹衤覀西见角讠贝车辶辶辶阝钅長镸长门雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾齐齿龙",
)
#: Not drawn at all, besides the characters of category Cf and the variation selectors.
_UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
_HYPHENS = "‐‑‒–⁃˗−﹣－"
#: Compatibility forms that are drawn like what they stand for. Circled, squared,
#: super- and subscript, fraction and styled forms look different and stay.
_SAME_DRAWING = ("<wide>", "<narrow>", "<compat>", "<small>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")

_LOOKALIKE: dict[str, str] = {}
for _from, _to in (*_LETTERS, _RADICALS):
    assert len(_from) == len(_to)
    _LOOKALIKE |= dict(zip(_from, _to, strict=True))


def prototype(ch: str) -> str:
    """What a single character is drawn like, '' if it isn't drawn."""
    cat = unicodedata.category(ch)
    if cat == "Cf" or ch in _UNSEEN or "︀" <= ch <= "️" or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if cat == "Zs":
        return " "
    if ch in _HYPHENS:
        return "-"
    if ch in _LOOKALIKE:
        return _LOOKALIKE[ch]
    tag, _, points = unicodedata.decomposition(ch).partition(" ")
    if tag in _SAME_DRAWING:
        return "".join(prototype(chr(int(p, 16))) for p in points.split())
    return ch


class _Table(dict):
    """Prototypes by code point, worked out at first sight."""

    def __missing__(self, code: int) -> str:
        self[code] = p = prototype(chr(code))
        return p


_TABLE = _Table()


def skeleton(text: str) -> str:
    if text.isascii():
        return text
    decomposed = unicodedata.normalize("NFD", text).translate(_TABLE)
    return unicodedata.normalize("NFD", decomposed)


def with_skeleton(df: DataFrame, column: str, name: str = "skeleton") -> DataFrame:
    """Add the skeleton of a text column; null stays null, '' stays ''."""
    ship(df.sparkSession)
    schema = T.StructType(list(df.schema.fields)).add(name, "string")
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([None if s is None else skeleton(s) for s in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, name])

    return df.mapInArrow(run, schema)


def classes(records: DataFrame) -> DataFrame:
    """records (table_name, column_name, id, text) as their distinct rows with
    skeleton. Rows with a null id or text are left out."""
    r = records.select("table_name", "column_name", "id", "text").where("id is not null and text is not null").distinct()
    return with_skeleton(r, "text")


def groups(records: DataFrame) -> DataFrame:
    """One row per record: table_name, column_name, id, class_id (a hash of the
    common form), n_records and n_texts of its class, so exact copies need no pairs."""
    c = classes(records)
    key = ["table_name", "column_name", "skeleton"]
    per = c.groupBy(*key, "text").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("n_records"), F.count("*").alias("n_texts"))
    per = per.where("n_texts > 1").withColumn("k", F.struct(*key)).select("k", "n_records", "n_texts")
    joined = lookup_join(c.withColumn("k", F.struct(*key)), per, "k", spread=F.col("id"))
    return joined.select("table_name", "column_name", "id", F.sha2("skeleton", 256).alias("class_id"), "n_records", "n_texts")


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """Pairs of different records of one table and column whose texts look the same
    and differ: table_name, column_name, id_a < id_b (by code point).

    Only pairs of different texts are made, first between distinct texts of one
    skeleton, then between their records: records with the very same text, however
    many, meet each other nowhere. Clean, copied and empty tables give no rows."""
    c = spool(classes(records))
    key = ["table_name", "column_name", "skeleton"]
    texts = c.groupBy(*key, "text").agg(F.count("*").alias("n"))
    mixed = texts.groupBy(*key).agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select(*key)
    some = texts.join(mixed, key, "left_semi")
    pair = some.select(*key, F.col("text").alias("text_a")).join(some.select(*key, F.col("text").alias("text_b")), key).where("text_a <> text_b")
    pair = pair.select("table_name", "column_name", F.struct("table_name", "column_name", "text_a").alias("k"), "text_b")
    rec = c.select(F.struct("table_name", "column_name", F.col("text").alias("text_a")).alias("k"), "id")
    half = lookup_join(rec, pair, "k", spread=F.col("id")).select(F.struct("table_name", "column_name", F.col("text_b").alias("text_a")).alias("k"), F.col("id").alias("id_a"))
    full = lookup_join(rec, half, "k", spread=F.col("id")).where("id_a < id")
    return full.select("k.table_name", "k.column_name", "id_a", F.col("id").alias("id_b")).distinct()
