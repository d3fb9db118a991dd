"""Row predicates with the tabular null rules: "not" conditions keep nulls, all others drop them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.operators.quantiles import quantiles


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _date(c: Column) -> Column:
    return F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c.cast("string")))


def condition(df: DataFrame, spec: dict) -> Column:
    """One condition {"column", "op", "value" | "values" | "min" and "max" | "start" and "end"} as a Column."""
    c, op, v = F.col(spec["column"]), spec["op"], spec.get("value")
    values = spec.get("values", v if isinstance(v, list) else [v])
    text = c.cast("string")
    simple = {
        "equals": lambda: c == v,
        "not_equals": lambda: ~c.eqNullSafe(F.lit(v)),
        "contains": lambda: text.rlike(str(v)),
        "icontains": lambda: text.rlike(f"(?i){v}"),
        "not_contains": lambda: c.isNull() | ~text.rlike(str(v)),
        "starts_with": lambda: text.startswith(str(v)),
        "ends_with": lambda: text.endswith(str(v)),
        "gt": lambda: _number(c) > v,
        "lt": lambda: _number(c) < v,
        "gte": lambda: _number(c) >= v,
        "lte": lambda: _number(c) <= v,
        "is_null": c.isNull,
        "not_null": c.isNotNull,
        "isin": lambda: c.isin(values),
        "not_isin": lambda: c.isNull() | ~c.isin(values),
        "between": lambda: _between(_number(c), spec),
        "regex": lambda: text.rlike(f"^(?:{v})"),
        "search": lambda: text.rlike(str(v)),
        "not_search": lambda: ~F.coalesce(text.rlike(str(v)), F.lit(False)),
        "date_range": lambda: _within(_date(c), spec),
    }
    if op not in simple:
        raise ValueError(f"unknown condition {op!r}; known: {', '.join(sorted([*simple, 'quantile_between']))}")
    if spec["column"] not in df.columns:
        raise ValueError(f"no column {spec['column']!r}")
    return simple[op]()


def _between(c: Column, spec: dict) -> Column:
    side = spec.get("inclusive", "both")
    low = c >= spec["min"] if side in ("both", "left") else c > spec["min"]
    return low & (c <= spec["max"] if side in ("both", "right") else c < spec["max"])


def _within(c: Column, spec: dict) -> Column:
    out = c.isNotNull()
    if spec.get("start"):
        out &= c >= F.to_timestamp(F.lit(spec["start"]))
    return out & (c <= F.to_timestamp(F.lit(spec["end"]))) if spec.get("end") else out


def filter_rows(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """Rows that meet all conditions; quantile_between takes one row of quantiles that Spark broadcasts."""
    plain = [condition(df, s) for s in conditions if s["op"] != "quantile_between"]
    out = df.where(reduce(lambda a, b: a & b, plain)) if plain else df
    for s in conditions:
        if s["op"] == "quantile_between":
            out = filter_quantile(out, s["column"], s.get("min", 0.0), s.get("max", 1.0))
    return out


def filter_quantile(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    q = quantiles(df, [column], (low, high)).withColumnRenamed("q0", "_q")  # one row
    return df.join(F.broadcast(q), F.col(column).between(F.get("_q", F.lit(0)), F.get("_q", F.lit(1)))).drop("_q")
