"""Writes with the semantics of a keyed table: insert-ignore, upsert, keyed update."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import scores

# Columns an upsert may change; all others keep their stored value.
UPSERT_COLUMNS = (
    "critic_score", "audience_score", "gap", "gap_label", "poster_url",
    "scores_fetched_on", "audience_score_source",
)


#: Parts a group is cut in before its rows meet; none unless a caller asks.
SALTS = 0


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "place",
    salts: int = SALTS,
) -> DataFrame:
    """The first n rows of every group in a total order, with their rank.

    The bound on the row number lets Spark cut every map partition to n rows per
    group before the shuffle. What a hot group then sends to its one task grows
    with the number of map tasks only: n rows for each. Where that is too much, ``salts``
    deals the map tasks to that many parts of the group, each cut to n rows of its own
    first, at the price of one more shuffle of what is left.
    """
    if salts:
        salted = df.withColumn("_salt", F.spark_partition_id() % salts)
        part = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
        df = salted.withColumn("_part", part).where(F.col("_part") <= n).drop("_salt", "_part")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key, by ``order`` (values, ascending, null first) and then by
    the row's other columns.

    An aggregate: every task keeps one row per key before the one shuffle, so many copies
    of a key are cheap and no key is hot. An order column given by its name travels once;
    a Column travels beside the row.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    # a key is the same in all its rows and orders nothing
    order = [o for o in order if not (isinstance(o, str) and o in keys)]
    named = [o for o in order if isinstance(o, str)]
    places = [F.col(o) if isinstance(o, str) else o.alias(f"__{i}") for i, o in enumerate(order)]
    rest = [c for c in others if c not in named]
    row = [F.struct(*rest).alias("__row")] if rest else []
    first = F.min(F.struct(*places, *row)).alias("__first")
    fields = {c: F.col("__first").getField(c) for c in named}
    fields |= {c: F.col("__first").getField("__row").getField(c) for c in rest}
    return df.groupBy(*keys).agg(first).select(*[fields[c].alias(c) if c in fields else c for c in df.columns])


def new_rows(
    stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column | str]
) -> DataFrame:
    """Incoming rows an insert-ignore would add.

    Rows with a NULL in their key never collide. The stored table is first cut to
    the keys that come in: a small batch is then broadcast against it and the
    large side is scanned without a shuffle, only for its key columns.
    """
    complete = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    firsts = first_per_key(incoming.where(complete), keys, order)
    asked = incoming.where(complete).select(*keys).distinct()
    present = stored.select(*keys).join(asked, keys, "left_semi")
    return firsts.join(present, keys, "left_anti").unionByName(incoming.where(~complete))


def insert_ignore(
    stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column | str]
) -> DataFrame:
    """The stored table after an insert that skips existing keys."""
    added = new_rows(stored, incoming, keys, order)
    return stored.unionByName(added, allowMissingColumns=True)


def collapse_updates(
    incoming: DataFrame, key: str, order: Column, latest: list[str]
) -> DataFrame:
    """One row per key as if the rows had been written one after the other.

    ``latest`` columns end with their last value that is not NULL, the others
    keep the first row's value. Plain aggregates, combined before the shuffle.
    """
    picks = []
    for c in incoming.columns:
        if c == key:
            continue
        if c in latest:
            picks.append(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c))
        else:
            picks.append(F.min_by(c, order).alias(c))
    return incoming.groupBy(key).agg(*picks)


def upsert(
    stored: DataFrame, incoming: DataFrame, key: str, update: tuple[str, ...] | list[str]
) -> DataFrame:
    """Insert unknown keys; for known ones fill ``update`` columns, NULL never wins.

    Both sides hold one row per key (see ``collapse_updates``), so the full outer
    join has no hot key.
    """
    old = stored.withColumn("_old", F.lit(True)).alias("o")
    new = incoming.withColumn("_new", F.lit(True)).alias("n")
    columns = []
    for c in stored.columns:
        if c == key:
            columns.append(F.col(key))
        elif c not in incoming.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        elif c in update:
            columns.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            columns.append(
                F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
            )
    return old.join(new, key, "full").select(*columns)


def upsert_films(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Film upsert; the label follows the merged gap."""
    merged = upsert(stored, incoming, "film_link", UPSERT_COLUMNS)
    return merged.withColumn("gap_label", scores.gap_label(F.col("gap")))


def merge_updates(
    base: DataFrame,
    updates: DataFrame,
    key: str,
    overwrite: tuple[str, ...] | list[str] = (),
    fill: tuple[str, ...] | list[str] = (),
) -> DataFrame:
    """Apply keyed updates in one pass; ``updates`` holds one row per key.

    ``overwrite`` columns take the new value even when NULL, ``fill`` columns only
    when it is not. Keys absent from ``base`` are ignored, as an UPDATE would.
    """
    new = updates.withColumn("_hit", F.lit(True)).alias("n")
    columns = []
    for c in base.columns:
        if c in overwrite:
            columns.append(
                F.when(F.col("_hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            )
        elif c in fill:
            columns.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            columns.append(F.col(key) if c == key else F.col(f"o.{c}").alias(c))
    return base.alias("o").join(new, key, "left").select(*columns)


def apply_scores(films: DataFrame, scored: DataFrame, now) -> DataFrame:
    """Write score results (film_link, critic_score, audience_score) to films.

    A row with neither score only gets the attempt stamp, so it is not tried again.
    """
    usable = F.col("critic_score").isNotNull() | F.col("audience_score").isNotNull()
    gap = scores.gap(F.col("critic_score"), F.col("audience_score"), 2)
    stamped = scored.select(
        "film_link",
        F.col("critic_score"),
        F.col("audience_score"),
        F.when(F.col("audience_score").isNotNull(), fixed.PROXY_SOURCE).alias(
            "audience_score_source"
        ),
        gap.alias("gap"),
        F.when(usable, scores.gap_label(gap)).alias("gap_label"),
        now.alias("scores_fetched_on"),
        usable.alias("_usable"),
    )
    joined = films.alias("o").join(stamped.alias("n"), "film_link", "left")
    score_columns = {"critic_score", "audience_score", "audience_score_source", "gap", "gap_label"}
    columns = []
    for c in films.columns:
        if c in score_columns:
            columns.append(
                F.when(F.col("_usable"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            )
        elif c == "scores_fetched_on":
            columns.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            columns.append(F.col(c) if c == "film_link" else F.col(f"o.{c}").alias(c))
    return joined.select(*columns)
