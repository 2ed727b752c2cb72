"""Gates: rows without a violation, or no rows at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict(df: DataFrame, violations: DataFrame) -> DataFrame:
    """The rows of df; reading them, or counting them, fails if there is a violation. The error names how many and
    the least of them as JSON. The check is a branch of its own, which runs whether df has rows or not."""
    found = violations.agg(F.count("*").alias("_n"), F.min(F.to_json(F.struct(*violations.columns))).alias("_least"))
    text = F.concat(F.col("_n").cast("string"), F.lit(" violations, of which "), F.col("_least"))
    stop = found.filter(F.when(F.col("_n") > 0, F.raise_error(text).cast("boolean")).otherwise(F.lit(False)))
    return df.unionByName(stop.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


def gate(df: DataFrame, violations: DataFrame, keys: str | list[str], must: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows that have no violation, and the violations; with ``must`` all rows, if there is no violation at all.

    Rows and violations meet on the keys, nulls too. A violation whose keys are all null is one of the whole
    table: it stops a strict gate, while otherwise no row goes for it.
    """
    if must:
        return strict(df, violations), violations
    keys = [keys] if isinstance(keys, str) else keys
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNull()
    bad = violations.filter(~whole).select(*[F.col(k).alias(f"_bad_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on &= df[k].eqNullSafe(bad[f"_bad_{k}"])
    return df.join(bad, on, "left_anti"), violations
