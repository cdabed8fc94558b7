"""Behaviour sequences, sessions and negative samples.

Order matters inside one user, and one user may own a third of all rows.  Hot
users are therefore cut into slots that are worked on apart; what a slot
needs from earlier slots (the last k items, the last event time) is carried over
from one short summary row per slot.  Ordinary users stay whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.operators.hotkeys import ROWS_PER_SLOT, add_slots
from clickloom.operators.lookups import identified
from clickloom.operators.ranking import top_per_group
from clickloom.storage import materialize


def _values(steps: Column | str, item: str) -> Column:
    return F.transform(steps, lambda s: s[item])


def _last(arr: Column, k: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - k + 1, F.lit(1)), k)


def history(
    df: DataFrame,
    user: str,
    order: Sequence[str],
    items: Sequence[str],
    k: int,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Add ``hist_<item>`` = up to ``k`` earlier values (oldest first) and ``seq_length``."""
    rows = add_slots(df, user, order, rows_per_slot)
    step = F.struct(*order, *[i for i in items if i not in order])
    inside = Window.partitionBy(user, "_slot").orderBy(*order).rowsBetween(-k, -1)
    own = rows.withColumn("_own", F.collect_list(step).over(inside))

    # hot users only: the last k items of each slot, then of all slots before it
    newest = [F.col(o).desc() for o in order]
    tails = (
        top_per_group(rows.where(F.col("_slot").isNotNull()), [user, "_slot"], newest, k, "_rn")
        .groupBy(user, "_slot")
        .agg(F.array_sort(F.collect_list(step)).alias("_tail"))
    )
    before = Window.partitionBy(user).orderBy("_slot").rowsBetween(-k, -1)
    carried = tails.select(
        F.col(user).alias("_u"), F.col("_slot").alias("_s"), F.flatten(F.collect_list("_tail").over(before)).alias("_carry")
    )
    joined = own.join(carried, (F.col(user) == F.col("_u")) & (F.col("_slot") == F.col("_s")), "left")
    steps = F.when(F.col("_carry").isNull(), F.col("_own")).otherwise(_last(F.concat("_carry", "_own"), k))
    return joined.withColumn("_steps", steps).select(
        *df.columns,
        *[_values("_steps", i).alias(f"hist_{i}") for i in items],
        F.size("_steps").alias("seq_length"),
    )


def last_k_text(hist: str, sep: str = ",") -> Column:
    """History as delimited text, the form a token feature reads."""
    return F.array_join(F.col(hist).cast("array<string>"), sep)


def session_starts(
    df: DataFrame,
    user: str,
    epoch: str,
    order: Sequence[str],
    gap: float,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Add ``session_start``: time of the event that opened the row's session.

    ``gap`` is in the unit of the ``epoch`` column, which leads ``order``.
    """
    rows = add_slots(df, user, order, rows_per_slot)
    slots = (
        rows.where(F.col("_slot").isNotNull())
        .groupBy(user, "_slot")
        .agg(F.max(epoch).alias("_end"))
        .select(
            F.col(user).alias("_u"),
            F.col("_slot").alias("_s"),
            F.lag("_end").over(Window.partitionBy(user).orderBy("_slot")).alias("_before"),
        )
    )
    inside = Window.partitionBy(user, "_slot").orderBy(*order)
    previous = F.coalesce(F.lag(epoch).over(inside), F.col("_before"))
    opened = (
        rows.join(slots, (F.col(user) == F.col("_u")) & (F.col("_slot") == F.col("_s")), "left")
        .drop("_u", "_s")
        .withColumn("_prev", previous)
        .withColumn(
            "_opens",
            F.when(F.col("_prev").isNull() | (F.col(epoch) - F.col("_prev") > gap), F.col(epoch)),
        )
    )
    own = F.last("_opens", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # a hot slot may begin in the middle of a session opened in an earlier slot
    earlier = (
        opened.where(F.col("_slot").isNotNull())
        .groupBy(user, "_slot")
        .agg(F.max("_opens").alias("_opened"))
        .select(
            F.col(user).alias("_u"),
            F.col("_slot").alias("_s"),
            F.max("_opened")
            .over(Window.partitionBy(user).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carried"),
        )
    )
    return (
        opened.withColumn("_own", own)
        .join(earlier, (F.col(user) == F.col("_u")) & (F.col("_slot") == F.col("_s")), "left")
        .select(*df.columns, F.coalesce("_own", "_carried").alias("session_start"))
    )


def session_split(
    df: DataFrame,
    user: str,
    epoch: str,
    order: Sequence[str],
    items: Sequence[str],
    gap: float = 1800,
    max_sessions: int = 5,
    max_len: int = 10,
    **slots,
) -> DataFrame:
    """Per user: ``sess_<i>_<item>`` arrays of the last sessions and ``sess_length``.

    Keeps the last ``max_sessions`` sessions and the last ``max_len`` items of
    each (both are properties of the feature); the limits apply in the map tasks.
    """
    rows = session_starts(df, user, epoch, order, gap, **slots)
    newest = [F.col(o).desc() for o in order]
    kept = top_per_group(rows, [user, "session_start"], newest, max_len, "_rn")
    step = F.struct(*order, *[i for i in items if i not in order])
    sessions = kept.groupBy(user, "session_start").agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    recent = top_per_group(sessions, [user], [F.col("session_start").desc()], max_sessions, "_rank")
    per_user = recent.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("session_start", "_steps"))).alias("_s"))
    arrays = [
        _values(F.get("_s", F.lit(n))["_steps"], i).alias(f"sess_{n}_{i}")
        for n in range(max_sessions)
        for i in items
    ]
    return per_user.select(user, *arrays, F.size("_s").alias("sess_length"))


#: Catalog places of a block, whose known ones are kept together.
PLACES = 1 << 15


def known_blocks(positives: DataFrame, user: str, places: int = PLACES) -> DataFrame:
    """(user, block, known, before): the known catalog places of a user by block, sorted, and how many lie in earlier blocks.

    A row holds at most ``places`` numbers and a user has at most a row for each
    block of the catalog, however many events made the positives.
    """
    block = F.floor(F.col("idx") / places)
    known = positives.where(F.col("idx").isNotNull()).select(user, "idx").distinct().groupBy(user, block.alias("block"))
    known = known.agg(F.sort_array(F.collect_list("idx")).alias("known"))
    earlier = Window.partitionBy(user).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return known.withColumn("before", F.coalesce(F.sum(F.size("known")).over(earlier), F.lit(0)))


def negative_history(
    df: DataFrame, key: Sequence[str], user: str, picks: Column, positives: DataFrame, catalog: DataFrame, out: str, places: int = PLACES
) -> DataFrame:
    """Add ``out``: for every number of the array ``picks`` an item the user never touched.

    ``catalog`` is ``(idx, item)`` with idx 0..n-1, ``positives`` is ``(user, idx)``,
    ``picks`` any integer hashes.  A pick selects the f-th of the places the user
    does not know, f being its remainder by their number.  With the known places
    a_0 < a_1 < ... that is place f + j for the j known ones with a_i - i <= f:
    the last block whose first known place fulfils this says how many come
    before it, the block itself the rest.  Both are equi-joins on the user, whose
    rows adaptive execution splits where a user is hot.  An element is NULL only
    if the user knows the whole catalog; an array without picks gives an empty one.
    """
    df, key = identified(df, key)
    n = catalog.agg(F.count(F.lit(1))).scalar()
    blocks = materialize(known_blocks(positives, user, places), "known-blocks")
    first = F.struct("block", "before", (F.element_at("known", 1) - F.col("before")).alias("least"))
    heads = blocks.groupBy(F.col(user).alias("_u")).agg(  # at most one entry a block of the catalog
        F.sort_array(F.collect_list(first)).alias("_heads"), F.sum(F.size("known")).alias("_known")
    )
    each = df.select(*key, F.col(user).alias("_user"), F.posexplode(picks).alias("_pos", "_pick"))
    free = n - F.coalesce("_known", F.lit(0))
    each = each.join(heads, F.col("_user") == F.col("_u"), "left").withColumn("_f", F.when(free > 0, F.pmod("_pick", free)))
    each = each.withColumn("_head", F.try_element_at(F.filter("_heads", lambda h: h["least"] <= F.col("_f")), F.lit(-1)))
    each = each.select(*key, "_user", "_pos", "_f", F.col("_head.block").alias("_block"), F.col("_head.before").alias("_before"))
    inside = blocks.select(F.col(user).alias("_u"), F.col("block").alias("_b"), "known")
    each = each.join(inside, (F.col("_user") == F.col("_u")) & (F.col("_block") == F.col("_b")), "left")
    passed = F.size(F.filter("known", lambda a, i: a - (F.col("_before") + i) <= F.col("_f")))
    place = F.col("_f") + F.when(F.col("_b").isNull(), F.lit(0)).otherwise(F.col("_before") + passed)
    names = catalog.select(F.col("idx").alias("_c"), F.col("item").alias("_item"))
    each = each.select(*key, "_pos", place.alias("_place")).join(names, F.col("_place") == F.col("_c"), "left")
    back = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_steps"))
    empty = F.array().cast(f"array<{catalog.schema['item'].dataType.simpleString()}>")
    return df.join(back, key, "left").withColumn(out, F.coalesce(_values("_steps", "_item"), empty)).drop("_steps", "_number")


def negatives(
    steps: DataFrame, user: str, positives: DataFrame, catalog: DataFrame, pick: Column, out: str = "neg_item", key: Sequence[str] = ()
) -> DataFrame:
    """Add one item the user never touched to every row: ``negative_history`` of a single pick."""
    one = negative_history(steps, key, user, F.array(pick.cast("long")), positives, catalog, out)
    return one.select(*steps.columns, F.get(out, F.lit(0)).alias(out))
