"""Seeded samples of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = "42"


def seeded(*cols: str):
    """A sampling order: an md5 of the seed and a row's key."""
    return F.md5(F.concat_ws(":", F.lit(SEED), *(F.col(c).cast("string") for c in cols)))


def first_of(rows: DataFrame, by: list[str], want: str, order: tuple[str, ...] = ("h", "instance_id")) -> DataFrame:
    """The first ``want`` rows (an expression over ``by``) of each group with their place: first within 64 parts of a group, so that
    no task orders a whole group, then over what they kept."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64)))
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).filter(f"_r <= {want}")
    return part.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(f"place <= {want}").drop("_part", "_r")
