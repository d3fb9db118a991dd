"""Delimited, JSON and Parquet tables in and out, header and blank handling, and versions of stored tables."""

from __future__ import annotations

import itertools
import json
import re
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Texts that count as missing in delimited files.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TRUTHS = ["True", "TRUE", "true", "False", "FALSE", "false"]
WHOLE, NUMBER = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)inf(inity)?)\s*$"
#: What windows-1252 has in place of the control characters from U+0080 on; the five bytes it leaves out mark latin-1.
_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_LATIN, _WINDOWS = ("".join(bytes([b]).decode(c) for b in _BYTES) for c in ("latin-1", "cp1252"))
UTF8, WINDOWS, LATIN = "UTF-8", "windows-1252", "ISO-8859-1"


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, broken): which encoding each file at path is read in, and whether quoted line breaks are in it.

    UTF-8 if all lines are valid, else windows-1252 unless a byte occurs that it hasn't, else latin-1. One pass over lines.
    """
    lines = spark.read.text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("raw"), "value")
    quotes = F.length("raw") - F.length(F.regexp_replace(F.decode("raw", LATIN), '"', ""))
    none = F.decode("raw", LATIN).rlike("[\u0081\u008d\u008f\u0090\u009d]")
    one = lines.groupBy(F.col("file_path").alias("file")).agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(none).alias("none"), F.bool_or(quotes % 2 == 1).alias("broken"))
    return one.select("file", F.when(F.col("utf8"), UTF8).when(F.col("none"), LATIN).otherwise(WINDOWS).alias("encoding"), "broken")


def column_names(values: list[str | None]) -> list[str]:
    """Trimmed names of a header row; empty ones are "Unnamed: place", and repeats get the next free .1, .2, ..."""
    out: list[str] = []
    for i, v in enumerate(values):
        name = (v or "").strip() or f"Unnamed: {i}"
        free = (n for n in itertools.chain([name], (f"{name}.{k}" for k in itertools.count(1))) if n not in out)
        out.append(next(free))
    return out


def _texts(spark: SparkSession, files: list[str], separator: str, encoding: str, broken: bool, header: bool = True) -> DataFrame:
    """The records of files of one layout as texts, by the header of the first; records with too many fields go."""
    options = {"sep": separator, "encoding": UTF8 if encoding == UTF8 else LATIN, "multiLine": broken, "escape": '"', "mode": "PERMISSIVE"}
    cleared = lambda c: F.translate(c, _LATIN, _WINDOWS) if encoding == WINDOWS else c
    first = spark.read.csv(files[0], header=False, inferSchema=False, **options).limit(1)
    row = first.select(*(cleared(F.col(c)).alias(c) for c in first.columns)).first()
    if row is None:
        return spark.createDataFrame([], "empty string").drop("empty")
    n = len(row)
    names = column_names([x.lstrip("\ufeff") if i == 0 and x else x for i, x in enumerate(row)]) if header else [f"c{i}" for i in range(n)]
    schema = ", ".join([*(f"c{i} string" for i in range(n)), "bad string"])
    found = spark.read.option("columnPruning", False).csv(files, header=header, schema=schema, columnNameOfCorruptRecord="bad", enforceSchema=True, **options)  # fields are counted, so all are parsed
    bare = F.regexp_replace("bad", '"([^"]|"")*"', "")
    fields = 1 + (F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit("")))) / len(separator)
    # Spark asks for another column beside the whole record, even where rows are only counted
    zero = F.least(F.length(F.coalesce("c0", F.lit(""))), F.lit(0))
    found = found.where(F.col("bad").isNull() | (fields + zero <= n))
    return found.select(*(cleared(F.col(f"c{i}")).alias(names[i]) for i in range(n)))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose values are all whole numbers, numbers or truths as such, in one pass; MISSING texts become null.

    Numbers may have nulls, truths may not. Whole numbers beyond 64 bits are doubles. Dates stay texts.
    """
    quoted = [f"`{c.replace('`', '``')}`" for c, t in df.dtypes if t == "string"]
    if not quoted:
        return df
    df = df.withColumns({c.strip("`").replace("``", "`"): F.when(~F.col(c).isin(MISSING), F.col(c)) for c in quoted})
    count = lambda cond: F.count(F.when(cond, 1))
    one = df.agg(F.count(F.lit(1)), *(f for c in quoted for f in (F.count(c), count(F.col(c).rlike(WHOLE) & F.trim(c).try_cast("long").isNotNull()), count(F.col(c).rlike(NUMBER)), count(F.col(c).isin(TRUTHS))))).first()
    kinds = {}
    for k, c in enumerate(quoted):
        filled, whole, number, truth = one[1 + 4 * k : 5 + 4 * k]
        kind = "double" if not filled else "long" if whole == filled else "double" if number == filled else "boolean" if truth == one[0] else None
        if kind:
            kinds[c.strip("`").replace("``", "`")] = F.trim(c).try_cast(kind)
    return df.withColumns(kinds)


def read_csv(spark: SparkSession, path: str, separator: str = ",", encoding: str | None = None, max_rows: int = 0, infer: bool = True) -> DataFrame:
    """A delimited table by its header's trimmed names; max_rows: keep so many rows (0: all).

    encoding: found from the bytes of each file (see layouts()) unless given as UTF-8, windows-1252 or ISO-8859-1. Files are
    split among tasks unless quoted line breaks are in them. Records with more fields than the header go, those with fewer are
    filled with nulls. MISSING texts are nulls, and columns get types, if infer; all columns are texts if not. A file without
    any line gives a table without columns. Files of a folder have the first one's header.
    """
    found = [(r["file"], r["encoding"], r["broken"]) for r in layouts(spark, path).orderBy("file").collect()]  # a row a file
    groups: dict = {}
    for file, own, broken in found:
        groups.setdefault((encoding or own, bool(broken)), []).append(file)
    parts = [_texts(spark, files, separator, *layout) for layout, files in groups.items()]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], "empty string").drop("empty")
    df = df.limit(max_rows) if max_rows else df
    return infer_types(df) if infer else df


def promote_header(spark: SparkSession, path: str, row: int = 0, separator: str = ",") -> DataFrame:
    """The delimited file at path with the record of that number (from 0) as names, and those after it as rows, with types.

    A null name is col_ and its place.
    """
    ((_, encoding, broken),) = [tuple(r) for r in layouts(spark, path).collect()]
    raw = _texts(spark, [path], separator, encoding, bool(broken), header=False).withColumn("_at", F.monotonically_increasing_id())
    head = raw.limit(row + 1).collect()
    if row < 0 or len(head) <= row:
        raise ValueError(f"row {row} is out of range")
    kept = [c for c in raw.columns if c != "_at"]
    values = [head[row][c] for c in kept]
    names = [f"col_{i}" if v is None or v in MISSING else v for i, v in enumerate(values)]
    return infer_types(raw.where(F.col("_at") > head[row]["_at"]).select(*kept)).toDF(*column_names(names))


def write(df: DataFrame, path: str, kind: str = "parquet", separator: str = ",") -> None:
    """kind: parquet, csv or json. Spark's committer makes the new files visible only when all are written."""
    out = df.write.mode("overwrite")
    {"parquet": lambda: out.parquet(path), "csv": lambda: out.csv(path, header=True, sep=separator, escape='"'), "json": lambda: out.json(path)}[kind]()


def convert(spark: SparkSession, source: str, target: str, kind: str = "parquet", separator: str = ",") -> DataFrame:
    """A CSV table stored as another kind; returns what was stored."""
    write(read_csv(spark, source, separator), target, kind, separator)
    return {"parquet": spark.read.parquet, "csv": lambda p: read_csv(spark, p, separator), "json": spark.read.json}[kind](target)


def normalize_headers(df: DataFrame, lowercase: bool = True, replace_spaces: bool = True) -> DataFrame:
    """Trimmed names, in lower case, with single underscores for spaces; empty ones are col, and repeats get the next free number from 2."""
    out: list[str] = []
    for c in (x.strip() for x in df.columns):
        c = c.lower() if lowercase else c
        c = re.sub("_+", "_", re.sub(r"\s", "_", c)) if replace_spaces else c
        c = c or "col"
        free = (n for n in itertools.chain([c], (f"{c}_{k}" for k in itertools.count(2))) if n not in out)
        out.append(next(free))
    return df.toDF(*out)


def trim_empty(df: DataFrame) -> DataFrame:
    """Blank texts become null; rows and then columns that are all null go. One pass finds the columns."""
    texts = [c for c, t in df.dtypes if t == "string"]
    df = df.withColumns({c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in texts}).dropna("all")
    filled = df.agg(*(F.count(F.col(c)).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if filled[c])) if filled else df


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def snapshot(spark: SparkSession, path: str) -> str:
    """Store the Parquet table at path as a new version beside it; returns the version's name."""
    name = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    spark.read.parquet(path).write.parquet(f"{path}.versions/{name}")
    return name


def list_versions(spark: SparkSession, path: str) -> list[str]:
    at, fs = _files(spark, f"{path}.versions")
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def restore(spark: SparkSession, path: str, version: str) -> None:
    """Put a version in place of the table at path, after storing what is there as a version."""
    old = spark.read.parquet(f"{path}.versions/{version}")
    snapshot(spark, path)
    write(old, path)


def append_receipt(spark: SparkSession, path: str, tool: str, arguments: dict, result: str = "") -> None:
    """Add one row to the log of what was done to the table at path."""
    row = (datetime.now(timezone.utc).replace(tzinfo=None), tool, json.dumps(arguments, sort_keys=True, default=str), result)
    spark.createDataFrame([row], "at timestamp, tool string, arguments string, result string").write.mode("append").parquet(f"{path}.receipts")


def read_receipts(spark: SparkSession, path: str, last: int = 10) -> DataFrame:
    return spark.read.parquet(f"{path}.receipts").orderBy(F.desc("at")).limit(last)
