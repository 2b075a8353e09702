"""The as-of reads as SQL functions, for users who query in SQL.

`visible_at` is a scalar function and every registered table gets a table
function `<name>_as_of(cutoff)`. Both are SQL text, so the predicate is inlined
and reaches the scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.temporal import VISIBLE_SQL


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Create `visible_at` and, per table, a view `<name>` and a table function `<name>_as_of`."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION visible_at(known_at BIGINT, superseded_at BIGINT, cutoff BIGINT) "
        f"RETURNS BOOLEAN RETURN {VISIBLE_SQL}"
    )
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_as_of(cutoff BIGINT) RETURNS TABLE ({columns}) "
            f"RETURN SELECT {', '.join(f'`{c}`' for c in df.columns)} FROM {name} "
            f"WHERE visible_at({name}.known_at, {name}.superseded_at, {name}_as_of.cutoff)"
        )
