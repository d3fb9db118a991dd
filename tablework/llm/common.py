"""What the corpus operators share: the staging folder, reading tables and bucketed arrays."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a session on this machine alone (tests) gets a
    temporary one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tablework-"))
    return _OWN[0]


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends there and lost executors cost only their own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # what has been written needs its shuffles no more, so Spark may delete their files at once
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete what stage() wrote, once nothing that is still to run reads it."""
    for df in staged:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_row(function):
    """function(docs, ...) where docs may have null or repeated doc_ids: it sees each row as a document of its own.

    Where doc_ids aren't unique, rows are numbered by doc_id (nulls last) and text, staged under their numbers as doc_id and
    given their own back; otherwise doc_ids are taken as they are.
    """

    @functools.wraps(function)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        if not _odd(docs):
            return function(docs, *args, **more)
        rows = docs.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn("_doc_id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id())
        found = function(stage(rows, "rows"), *args, **more)
        return found.withColumn("doc_id", F.col("_doc_id")).select(*docs.columns)

    return run


def own_rows(*names: str):
    """Decorates function(docs, ...) whose result has doc_ids in columns of these names: it sees each row as a document of its own.

    Where doc_ids are null or repeated, rows are numbered as by_row() does, nulls last and equal ids by their texts, and the
    result has the rows' own doc_ids again. So a smallest doc_id is that of the first row in this order.
    """

    def decorate(function):
        @functools.wraps(function)
        def run(docs: DataFrame, *args, **more) -> DataFrame:
            if not _odd(docs):
                return function(docs, *args, **more)
            rows = stage(docs.select("doc_id", "text").orderBy(F.asc_nulls_last("doc_id"), F.asc_nulls_last("text")).select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("doc_id").alias("own")), "rows")
            found = function(rows.select("doc_id", "text"), *args, **more)
            columns = found.columns
            for k, name in enumerate(names):
                number, own = f"_number_{k}", f"_own_{k}"
                found = found.join(rows.select(F.col("doc_id").alias(number), F.col("own").alias(own)), F.col(name) == F.col(number), "left").drop(name, number).withColumnRenamed(own, name)
            return found.select(*columns)

        return run

    return decorate


def _odd(docs: DataFrame) -> bool:
    """Whether any doc_id is null or repeated."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()


def ranges(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive slices that have these lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def long_lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ranges(lengths).astype(np.int32)), pa.array(values.astype(np.int64, copy=False)))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


#: ASCII white space, the only word separator of `[^\x20\x09-\x0D]+`.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Places in a word whose bytes' numbers are kept at hand.
PLACES = 64


@functools.lru_cache(1)
def _numbers() -> np.ndarray:
    return mix(np.arange(1, 1 + PLACES * 256, dtype=np.uint64))


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, split at ASCII white space, and the number of words of each text.

    A word's hash is that of its bytes alone, the same in every process: each byte and its place in the word make one
    pseudo-random number, and these are summed. So no pattern of bytes, as periodic or self-similar words have, makes two
    words agree more often than chance. lower: A-Z count as a-z.
    """
    joined = b"\n".join(texts)
    joined = joined.lower() if lower else joined
    hashes, sizes = [], ranges(np.array([len(x) + 1 for x in texts], np.int64))
    buf = np.frombuffer(joined, np.uint8)
    inside = ~IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    counts = np.diff(np.searchsorted(starts, sizes))
    step = 1 << 20
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + step)))
            size = ends[at:to] - starts[at:to]
            first = ranges(size)
            place = np.arange(first[-1]) - np.repeat(first[:-1], size)
            letters = buf[place + np.repeat(starts[at:to], size)]
            cell = place * 256 + letters
            # words are short as a rule, and looking numbers up is faster than making them
            numbers = _numbers()[cell] if size.max() <= PLACES else mix(cell.astype(np.uint64) + np.uint64(1))
            hashes.append(mix(np.add.reduceat(numbers, first[:-1]) + size.astype(np.uint64)))
            at = to
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), counts
