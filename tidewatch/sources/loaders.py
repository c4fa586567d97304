"""Files of several shapes as tables of text columns.

Layout is decided by one aggregate over all lines; rows are then read by
Spark's own readers or projected from lines. Nothing but names of columns comes
to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources import prose

DELIMITERS = [",", "\t", ";", "|"]
WRAPPERS = ["data", "results", "records", "items"]
KEY_VALUE = r'(\S+?)\s*=\s*("(?:\\.|[^"])*"|[^\s=]+)(?=\s|$)'
SUFFIXES = {"csv": "csv", "json": "json", "jsonl": "ndjson", "ndjson": "ndjson", "txt": "text", "log": "text", "tsv": "csv"}


@dataclass(frozen=True)
class Loaded:
    df: DataFrame
    file: str
    format: str
    warning: str | None = None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _first_line(spark: SparkSession, path: str) -> str:
    row = _lines(spark, path).first()
    return (row[0] or "").lstrip("﻿") if row else ""


def sniff(header: str) -> str:
    """The first delimiter that the header line holds, else a comma."""
    return next((d for d in DELIMITERS if d in header), ",")


def load_csv(spark: SparkSession, path: str) -> Loaded:
    """A delimited file with a header; UTF-8, or Latin-1 where a line is not
    UTF-8. Repeated headers get a number. An empty file has no columns."""
    sep = sniff(_first_line(spark, path))
    latin = not _lines(spark, path).where(~F.is_valid_utf8("value")).isEmpty()
    said = [f"delimiter {sep!r}"] * (sep != ",") + ["read as latin-1"] * latin
    df = spark.read.csv(path, sep=sep, header=True, encoding="ISO-8859-1" if latin else "UTF-8", quote='"', escape='"')
    return Loaded(df, path, "csv", "; ".join(said) or None)


def _numbered(rows: DataFrame, cells: str) -> DataFrame:
    """Arrays as columns col0, col1, ...; short ones end in nulls."""
    width = rows.agg(F.max(F.size(cells))).first()[0] or 0
    return rows.select(*(F.get(cells, F.lit(i)).alias(f"col{i}") for i in range(width)))


def _is_list(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def load_json(spark: SparkSession, path: str) -> Loaded:
    """One JSON document: records, records under a wrapper's name, lists of
    equal length side by side, lists of cells, or a single record."""
    df = spark.read.json(path, multiLine=True, primitivesAsString=True)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if set(kinds) <= {"_corrupt_record"}:
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("cells"))
        return Loaded(_numbered(whole, "cells"), path, "json")
    wrapper = next((w for w in WRAPPERS if _is_list(kinds.get(w))), None)
    if wrapper and isinstance(kinds[wrapper].elementType, T.StructType):
        return Loaded(df.select(F.inline(wrapper)), path, "json")
    if wrapper and _is_list(kinds[wrapper].elementType):
        return Loaded(_numbered(df.select(F.explode(wrapper).alias("cells")), "cells"), path, "json")
    if kinds and all(map(_is_list, kinds.values())):
        return Loaded(df.select(F.inline(F.arrays_zip(*kinds))), path, "json")
    return Loaded(df, path, "json")


def load_ndjson(spark: SparkSession, path: str) -> Loaded:
    """A record a line; blank lines, comments and bad lines are left out."""
    return Loaded(spark.read.json(path, mode="DROPMALFORMED", primitivesAsString=True), path, "ndjson")


#: Columns that key=value lines may make.
MAX_KEYS = 2_000


def key_values(line: Column) -> Column:
    """Pairs key=value of a line as an array of structs, quotes taken off."""
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(KEY_VALUE), F.lit(1)).alias("k"), F.regexp_extract_all(line, F.lit(KEY_VALUE), F.lit(2)).alias("v"))
    return F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.regexp_replace(p["v"], r'^"(.*)"$', "$1").alias("v")))


def from_key_values(lines: DataFrame) -> DataFrame:
    """Lines of ``value`` as a table, one column for each key; the last of
    repeated keys counts, lines without a pair are left out. More than
    ``MAX_KEYS`` distinct keys are an error: such lines are no table."""
    pairs = lines.select(key_values(F.col("value")).alias("pairs")).where(F.size("pairs") > 0)
    keys = [r[0] for r in pairs.select(F.explode("pairs.k").alias("k")).distinct().orderBy("k").limit(MAX_KEYS + 1).collect()]
    if len(keys) > MAX_KEYS:
        raise ValueError(f"over {MAX_KEYS} distinct keys")
    value = lambda name: F.try_element_at(F.filter("pairs", lambda p: p["k"] == name), F.lit(-1))["v"]
    return pairs.select(*(value(k).alias(k) for k in keys))


def load_text(spark: SparkSession, path: str) -> Loaded:
    """The first layout that holds for at least half of the lines: JSON lines,
    key=value, a delimited table with a header, prose; else one text column."""
    lines = _lines(spark, path).where(F.trim("value") != "")
    header = _first_line(spark, path)
    line = F.col("value")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    found = dict(zip(prose.FIELDS, prose.fields(line), strict=True))
    is_json = F.trim(line).rlike(r"(?s)^\{.*\}$") & F.try_parse_json(line).isNotNull()
    tests = {"ndjson": share(is_json), "kv": share(line.rlike(KEY_VALUE)),
             "prose": share(prose.credible(*(found[c] for c in ("ts", "amount", "account", "counterparty"))))}
    held = [d for d in DELIMITERS if d in header]
    for i, d in enumerate(held):
        tests[f"all{i}"] = F.min(F.contains(line, F.lit(d)).cast("int"))
        tests[f"even{i}"] = share(F.size(F.split(line, f"[{d}]")) == header.count(d) + 1)
    got = lines.agg(F.count("*").alias("n"), *(c.alias(k) for k, c in tests.items())).first()
    if got["n"] and got["ndjson"] >= 0.5:
        return Loaded(load_ndjson(spark, path).df, path, "ndjson")
    if got["n"] and got["kv"] >= 0.5:
        return Loaded(from_key_values(lines), path, "kv")
    for i, d in enumerate(held):
        if got["n"] > 1 and got[f"all{i}"] and got[f"even{i}"] >= 0.5:
            # No quoting in this layout; short rows are padded with empty text.
            return Loaded(spark.read.csv(path, sep=d, header=True, quote="", ignoreLeadingWhiteSpace=False).na.fill(""), path, "delimited")
    if got["n"] and got["prose"] >= 0.5:
        rows = lines.select(*prose.fields(line))
        return Loaded(rows.where(prose.credible(*map(F.col, ("ts", "amount", "account", "counterparty")))), path, "prose")
    return Loaded(lines.select(line.alias("text")), path, "text", "no structure found; one text column")


LOADERS = {"csv": load_csv, "json": load_json, "ndjson": load_ndjson, "text": load_text}


def _kind(path: str) -> str | None:
    name = path.lower().removesuffix(".gz")
    return SUFFIXES.get(name.rpartition(".")[2])


def is_supported(path: str) -> bool:
    return _kind(path) is not None


def load_any(spark: SparkSession, path: str) -> Loaded:
    """By suffix, .gz allowed; ValueError for others."""
    kind = _kind(path)
    if kind is None:
        raise ValueError(f"unsupported file: {path}")
    return LOADERS[kind](spark, path)


def collect_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Supported files below ``paths``, sorted, each once; listed by Spark, so
    that remote folders work alike. File contents are not read."""
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path").distinct()
    return sorted(r[0] for r in seen.collect() if is_supported(r[0]))
