"""Input parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame

PARTITIONS = "cloakwork.input.partitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan out over as many partitions as the session setting ``cloakwork.input.partitions`` names.

    Unset, which is right for inputs of many files, nothing is shuffled. Setting it gives CPU-heavy narrow work on one
    small file enough tasks; rows go by a hash of their key, which is stable under task retries.
    """
    wanted = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(wanted), *keys) if wanted and not df.isStreaming else df


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """The same for narrow rows that much work hangs on: they are dealt out without the setting as well.

    A scan has a task for some megabytes of input, and one file's rows may all lie in one row group. Such rows are many in a
    megabyte, so all their work would be done by one task or a few, however many cores there are.
    """
    session = df.sparkSession
    if session.conf.get(PARTITIONS, None):
        return spread(df, *keys)
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 3 * session.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def spread_few(df: DataFrame, *keys: str) -> DataFrame:
    """The same for texts where they lie in fewer files than there is work for: a file may be a single row group, which one task
    reads and matches alone, however large it is. Tables of many files stay where they are."""
    session = df.sparkSession
    if not session.conf.get(PARTITIONS, None) and not df.isStreaming and len(df.inputFiles()) < 3 * session.sparkContext.defaultParallelism:
        return spread_small(df, *keys)
    return spread(df, *keys)
