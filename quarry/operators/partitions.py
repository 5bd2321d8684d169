"""How many partitions a step is dealt to, where the session's own number would let a task's memory grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task sorts or groups at a time.
TASK_ROWS = 500_000


def parts(df: DataFrame, rows: int, each: int = TASK_ROWS) -> int:
    """Partitions of at most about ``each`` rows, the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def dealt(df: DataFrame, rows: int, *keys: str, each: int = TASK_ROWS) -> DataFrame:
    """Dealt by keys; where the session's number of partitions is enough, adaptive execution may still join small ones."""
    n = parts(df, rows, each)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)
