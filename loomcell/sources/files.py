"""Files as tables: workbooks, manifests, directories, registries, byte ranges."""

from __future__ import annotations

import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcell.functions import scalars as S
from loomcell.runtime import ship

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _value(cell: ET.Element, shared: list[str]):
    kind, v = cell.get("t", "n"), cell.find("m:v", _NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind in ("str", "e"):
        return v.text
    if kind == "b":
        return v.text == "1"
    if re.fullmatch(r"-?\d+", v.text):
        return int(v.text)
    try:
        return float(v.text)
    except ValueError:
        return v.text


def workbook(content: bytes, first_row: int = 5) -> Iterator[tuple[str, int, str]]:
    """(sheet, row number, canonical JSON of the row) of a workbook: row 1 has the
    headers, data begin at first_row. Targets outside the archive and repeated
    headers are errors."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        rels = {r.get("Id"): r for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet"):
            rel = rels[sheet.get(_REL)]
            target = rel.get("Target").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            if rel.get("TargetMode") == "External" or ".." in path or path not in names:
                raise ValueError(f"sheet target outside the workbook: {target}")
            header: dict[int, str] = {}
            for row in ET.fromstring(z.read(path)).iter(f"{{{_NS['m']}}}row"):
                at = int(row.get("r"))
                vals = {_column(c.get("r")): _value(c, shared) for c in row.findall("m:c", _NS)}
                if at == 1:
                    header = {i: str(v) for i, v in vals.items() if v is not None}
                    if len(set(header.values())) < len(header):
                        raise ValueError("repeated header")
                elif at >= first_row:
                    rec = {header[i]: v for i, v in vals.items() if i in header and v is not None}
                    if rec:
                        yield sheet.get("name"), at, json.dumps(rec, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def read_workbooks(spark: SparkSession, path: str, first_row: int = 5) -> DataFrame:
    """Rows of all workbooks under a path: file, file_sha, table_name, row_number,
    row_json, row_sha. A workbook is one task's work; workbooks are spread."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for name, content in p.itertuples(index=False):
                sha = hashlib.sha256(content).hexdigest()
                rows = [(name, sha, t, r, j, hashlib.sha256(j.encode()).hexdigest()) for t, r, j in workbook(content, first_row)]
                yield pd.DataFrame(rows, columns=["file", "file_sha", "table_name", "row_number", "row_json", "row_sha"])

    return files.mapInPandas(run, "file string, file_sha string, table_name string, row_number int, row_json string, row_sha string")


def read_directory(spark: SparkSession, path: str, exclude: str = r"(^|/)(\.git|__pycache__)(/|$)") -> DataFrame:
    """Files under a path: path (relative), size, sha, extension, media_class."""
    root = re.sub(r"^file:/*|/+$", "", path)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.col("path"), f"^.*?{re.escape(root)}/", "")
    return f.select(rel.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha")).where(~F.col("path").rlike(exclude)).withColumn("extension", S.extension(F.col("path"))).withColumn("media_class", S.media_class(F.col("path")))


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest members (path, size, sha) against files: ok, missing, wrong_size,
    wrong_content, and unlisted files."""
    j = manifest.select("path", F.col("size").alias("s1"), F.col("sha").alias("h1")).join(files.select("path", F.col("size").alias("s2"), F.col("sha").alias("h2")), "path", "full_outer")
    return j.select("path", F.when(F.col("h1").isNull(), "unlisted").when(F.col("h2").isNull(), "missing").when(F.col("s1") != F.col("s2"), "wrong_size").when(F.col("h1") != F.col("h2"), "wrong_content").otherwise("ok").alias("state"))


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, refused with reason) of registry files {version, count, items}: the
    version must be 0.2, the count right, ids lm-dddddd and unique, months YYYY-MM,
    digests sha256:64 hex digits."""
    item = "struct<id:string,title:string,language:string,year:int,month:string,hash:string,canonical_url:string,date_confidence:string>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"version string, count int, items array<{item}>").alias("r"))
    each = raw.select("file", F.col("r.version").alias("version"), (F.col("r.count") == F.size("r.items")).alias("count_ok"), F.explode_outer("r.items").alias("i")).select("file", "version", "count_ok", "i.*")
    n = each.groupBy("id").agg(F.count("*").alias("n_id"))
    j = each.join(n, "id", "left")
    why = (F.when(F.coalesce(F.col("version"), F.lit("")) != "0.2", "version").when(~F.coalesce(F.col("count_ok"), F.lit(False)), "count").when(~F.coalesce(F.col("id").rlike(r"^lm-\d{6}$"), F.lit(False)), "id").when(F.col("n_id") > 1, "duplicate_id")
           .when(~F.coalesce(F.col("month").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False)), "month").when(~F.coalesce(F.col("hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False)), "hash"))
    j = j.withColumn("reason", why).drop("n_id", "count_ok", "version")
    return j.where("reason is null").drop("reason"), j.where("reason is not null")


def read_markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the tables in Markdown files: file, row (cells as an array)."""
    t = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.col("value").rlike(r"^\s*\|.*\|\s*$") & ~F.col("value").rlike(r"^[\s|:-]+$"))
    return t.select("file", F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x)).alias("row"))


def read_strict_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as canonical JSON; repeated member names and broken files are
    reported, a byte order mark is not: file, value, error."""

    def pairs(p):
        if len({k for k, _ in p}) < len(p):
            raise ValueError("repeated member")
        return dict(p)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for f, v in p.itertuples(index=False):
                try:
                    out.append((f, json.dumps(json.loads(v.removeprefix("﻿"), object_pairs_hook=pairs), ensure_ascii=False, sort_keys=True, separators=(",", ":")), None))
                except ValueError as e:
                    out.append((f, None, str(e)[:100]))
            yield pd.DataFrame(out, columns=["file", "value", "error"])

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(run, "file string, value string, error string")


def read_ranges(spark: SparkSession, base: str, requests: DataFrame, most: int = 16 << 20) -> DataFrame:
    """Byte ranges (object_key, first_byte, n_bytes) of files under a base folder;
    keys that leave the folder and ranges beyond `most` are refused with an error."""
    import os

    root = os.path.realpath(base)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for k, a, n in p[["object_key", "first_byte", "n_bytes"]].itertuples(index=False):
                full = os.path.realpath(os.path.join(root, k))
                if os.path.commonpath([root, full]) != root or n > most or a < 0 or n < 0:
                    out.append((k, a, n, None, "refused"))
                    continue
                try:
                    with open(full, "rb") as f:
                        f.seek(a)
                        out.append((k, a, n, f.read(n), None))
                except OSError as e:
                    out.append((k, a, n, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["object_key", "first_byte", "n_bytes", "content", "error"])

    return requests.mapInPandas(run, "object_key string, first_byte bigint, n_bytes bigint, content binary, error string")
