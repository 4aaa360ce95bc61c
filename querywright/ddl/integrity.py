"""Whole-table figures that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksum(df: DataFrame) -> DataFrame:
    """(n, checksum): the number of rows and an order-free hash; repeated rows count by the sum as well."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.concat_ws("-", F.coalesce(F.bit_xor(row), F.lit(0)).cast("string"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 31))), F.lit(0)).cast("string")).alias("checksum"),
    )
