"""Joins and flags that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOOKUP_SALTS = 16


def costly_tasks(spark: SparkSession) -> int:
    """Number of tasks for few bytes that cost much work: enough for all cores,
    where Spark would merge small shuffle partitions into fewer."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(wanted, 4 * spark.sparkContext.defaultParallelism)


def salted_lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    row_id: Sequence[str],
    salts: int = LOOKUP_SALTS,
    how: str = "left",
) -> DataFrame:
    """Equi-join with a dictionary-like ``table`` (few rows per key).

    Every key of ``table`` is repeated once per salt and ``df`` spreads its
    rows over the salts, so a hot key is shared by ``salts`` tasks if Spark
    shuffles.  No hint is given: Spark broadcasts ``table`` when its size is
    below the session's threshold, and otherwise sorts and merges.
    """
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int, *aggs: Column) -> DataFrame:
    """(keys, n, *aggs) for the groups above ``rows`` rows.

    The counts are combined map-side; whether the groups are broadcast is left
    to Spark, which knows their size.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs).where(F.col("n") > rows)


def in_blocks(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_id: str,
    right_id: str,
    left_rows: int,
    right_rows: int,
) -> tuple[DataFrame, DataFrame]:
    """Cut both sides into blocks of bounded size that meet pairwise.

    Adds ``left_block`` and ``right_block`` to both sides: a row of a hot key
    is in one block of its own side and is repeated for every block of the
    other, so grouping by (key, left_block, right_block) brings each pair of
    rows together exactly once and no group outgrows the block sizes.  The
    result is partitioned by (key, left_block, right_block).
    """

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        n = F.ceil(F.col("n") / rows).cast("int")
        return hot_groups(df, [key], rows).select(key, n.alias(name))

    tasks = costly_tasks(left.sparkSession)
    left_n, right_n = blocks(left, left_rows, "_ln"), blocks(right, right_rows, "_rn")

    def place(df: DataFrame, own: str, other: str, row_id: str, own_out: str, other_out: str):
        n_own, n_other = (F.coalesce(F.col(c), F.lit(1)) for c in (own, other))
        names = [*df.columns, own_out, other_out]
        # fresh column identities: the two sides may stem from the same table
        df = df.toDF(*df.columns)
        placed = (
            df.join(left_n, key, "left")
            .join(right_n, key, "left")
            .withColumn(own_out, F.pmod(F.xxhash64(row_id), n_own).cast("int"))
            .withColumn(other_out, F.explode(F.sequence(F.lit(0), n_other - 1)))
        )
        # a fixed number of tasks: merging small shuffle partitions would put
        # many costly pairs of blocks into one task
        return placed.select(*names).toDF(*names).repartition(tasks, key, "left_block", "right_block")

    return (
        place(left, "_ln", "_rn", left_id, "left_block", "right_block"),
        place(right, "_rn", "_ln", right_id, "right_block", "left_block"),
    )


def flag_repeats(df: DataFrame, keys: Sequence[str], seq: str, flag: str) -> DataFrame:
    """Adds ``flag``: another row with the same ``keys`` comes before this one.

    One definition for groups of every size: rows are in the order of ``seq``,
    NULL first, and rows that also share ``seq`` in the order of their hash, so
    exactly one row of a group is not flagged.  NULL keys are equal.  Ties are
    numbered within (keys, seq); the first ``seq`` of a group comes from an
    aggregate that combines before the shuffle, so no task sorts a whole group.
    """
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    tied = Window.partitionBy(*keys, seq).orderBy(F.xxhash64(*plain))
    numbered = df.withColumn("_tie", F.row_number().over(tied))
    names = [f"_k{i}" for i in range(len(keys))]
    first = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names))).agg(
        F.min(F.struct(seq)).alias("_first")
    )
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    is_first = F.col(seq).eqNullSafe(F.col(f"_first.{seq}")) & (F.col("_tie") == 1)
    return numbered.join(first, same).withColumn(flag, ~is_first).drop("_tie", "_first", *names)
