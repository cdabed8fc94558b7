"""Hot keys and the slots that cut them up.

A key is hot when its rows do not fit one slot.  Its rows are numbered in order
and cut every ``rows_per_slot`` rows, so no slot is larger than that, however
the rows lie in time: a burst within one second is cut as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.ranking import global_rank
from clickloom.storage import materialize

ROWS_PER_SLOT = 1_000_000


def hot_keys(df: DataFrame, key: str, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """The keys with more rows than fit one slot."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where((F.col("_n") > rows_per_slot) & F.col(key).isNotNull()).select(key)


def add_slots(
    df: DataFrame, key: str, order: Sequence[str], rows_per_slot: int = ROWS_PER_SLOT, out: str = "_slot"
) -> DataFrame:
    """Add a slot: NULL for ordinary keys, for hot ones 0, 1, ... along ``order``.

    The numbered rows of hot keys are stored; rows that tie in ``order`` are cut
    apart too, and keep their side.
    """
    hot = materialize(hot_keys(df, key, rows_per_slot), "hot-keys")
    ordinary = F.lit(None).cast("long").alias(out)
    if hot.isEmpty():
        return df.select("*", ordinary)
    # no hint: with more rows there are more hot keys, so Spark chooses by their stored size
    ranked = global_rank(df.join(hot, key, "left_semi"), [F.col(o).asc() for o in order], by=[key], out="_rn")
    slotted = ranked.select(*df.columns, F.floor((F.col("_rn") - 1) / rows_per_slot).cast("long").alias(out))
    return df.join(hot, key, "left_anti").select(*df.columns, ordinary).unionByName(slotted)
