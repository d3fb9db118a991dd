"""Saved pipelines: lists of {"op": name, ...} that become one lazy plan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.functions import conditions
from tablework.operators import columns as C
from tablework.operators import relations as R


def _filter(op: str):
    return lambda df, **spec: conditions.filter_rows(df, [{"op": op, **spec}])


#: Names of steps and what they call; arguments are those of the functions.
STEPS = {
    "drop_column": lambda df, columns: df.drop(*columns),
    "rename_column": lambda df, mapping: df.withColumnsRenamed(mapping),
    "clean_text": C.clean_text, "cast_column": C.cast_column, "replace_values": C.replace_values, "add_column": C.add_column, "column_math": C.add_column,
    "keep_frequent": C.keep_frequent, "cap_outliers": C.cap_outliers, "winsorize": C.winsorize, "normalize": C.normalize, "robust_scale": C.robust_scale, "fill_nulls": C.fill_nulls,
    "drop_duplicates": C.drop_duplicates, "dedup_subset": C.drop_duplicates, "label_encode": C.label_encode, "ordinal_encode": C.ordinal_encode, "binary_encode": C.binary_encode,
    "frequency_encode": C.frequency_encode, "one_hot": C.one_hot, "extract_regex": C.extract_regex, "regex_replace": C.regex_replace, "str_slice": C.str_slice, "split_column": C.split_column,
    "combine_columns": C.combine_columns, "date_diff": C.date_diff, "date_parts": C.date_parts, "rank_column": C.rank_column, "filter_top_n": C.top_n, "shift": C.shift, "rolling_agg": C.rolling,
    "cumulative": C.cumulative, "ewm": C.ewm, "log_transform": C.log_transform, "sqrt_transform": C.sqrt_transform, "clip_values": C.clip_values, "round_values": C.round_values,
    "bin_column": C.bin_column, "qbin_column": C.qbin_column,
    "abs_values": lambda df, column, name: df.withColumn(name, F.abs(column)),
    "sort": lambda df, by, ascending=True: df.orderBy(*(F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in by)),
    "filter_isin": _filter("isin"), "filter_not_isin": _filter("not_isin"), "filter_between": _filter("between"), "filter_date_range": _filter("date_range"),
    "filter_regex": lambda df, column, pattern, negate=False: conditions.filter_rows(df, [{"op": "not_search" if negate else "search", "column": column, "value": pattern}]),
    "filter_quantile": conditions.filter_quantile,
    "filter_rows": lambda df, conditions_: conditions.filter_rows(df, conditions_),
    "melt": R.melt, "aggregate": R.aggregate,
}


def check(steps: list[dict]) -> None:
    """An unknown name is an error."""
    unknown = [s.get("op") for s in steps if s.get("op") not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; known: {', '.join(sorted(STEPS))}")


def apply(df: DataFrame, steps: list[dict]) -> DataFrame:
    """All steps in order; an unknown name is an error before any of them is planned."""
    check(steps)
    for s in steps:
        df = STEPS[s["op"]](df, **{k: v for k, v in s.items() if k != "op"})
    return df


def save(spark: SparkSession, path: str, name: str, steps: list[dict]) -> None:
    """Add a version of the pipeline to the table at path; the latest one counts."""
    row = spark.createDataFrame([(name, json.dumps(steps))], "name string, steps string").withColumn("at", F.current_timestamp())
    row.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, name: str) -> list[dict]:
    row = spark.read.parquet(path).where(F.col("name") == name).orderBy(F.desc("at")).first()
    if row is None:
        raise ValueError(f"no pipeline {name!r}")
    return json.loads(row["steps"])
