"""Joins of tables with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import n_partitions


def key_sizes(small: DataFrame, rows: str) -> tuple[int, int]:
    """Sum and maximum of the rows that keys have; zeros if there is no key."""
    total, most = small.agg(F.sum(rows), F.max(rows)).first()
    return total or 0, most or 0


def skew_join(big: DataFrame, small: DataFrame, on: list[str], rows: str, how: str = "inner", hot: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """big joined with small, whose column ``rows`` says how many rows of big have a key.

    Keys with over 1 / ``hot`` of all those rows are fewer than ``hot``, however
    large the tables are: their rows of small are broadcast. The other keys meet
    by a shuffle, in which none holds more than that share. hot: 256, or the
    session's shuffle partitions if they are more; small: one row a key, cheap
    to read twice; how: inner or left; sizes: the key_sizes of small, where they
    are known.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    parts = n_partitions(big.sparkSession)
    total, most = sizes or key_sizes(small, rows)
    least = max(1, total // (hot or max(256, parts)))
    if most <= least:
        return big.join(small, on, how)
    many = small.where(F.col(rows) > least)
    few = small.where(~(F.coalesce(F.col(rows), F.lit(0)) > least))
    rest = big.join(F.broadcast(many.select(*on)), on, "left_anti").join(few, on, how)
    # without it, each join would add its partitions to those before
    return big.join(F.broadcast(many), on).unionByName(rest).coalesce(parts)
