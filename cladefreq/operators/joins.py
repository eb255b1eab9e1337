"""Joins and row picks that keep working when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one key that a task may hold; a key with more is spread over as many places as it takes.
TASK_ROWS = 1_000_000
#: A key is spread only if it holds more than this part of all rows, so no more than these keys can be.
PARTS = 10_000
MAX_LOOKUP_ROWS = 100_000


def first_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]
) -> DataFrame:
    """First full row of each key in the given order.

    Spark turns ``row_number() = 1`` into a group limit that runs before the
    shuffle, so a hot key sends at most one row per input task.
    """
    window = W.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def _same(left: Column, right: Column, null_matches: bool) -> Column:
    return left.eqNullSafe(right) if null_matches else left == right


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    counts: DataFrame,
    *,
    how: str,
    spread: Sequence[str],
    null_matches: bool = False,
    task_rows: int = TASK_ROWS,
    parts: int = PARTS,
) -> DataFrame:
    """Join facts to a dim that is unique on ``key``; ``counts`` (key, n) says how many facts each key has.

    A key with more than ``limit`` facts lies in ceil(n / limit) places: its dim
    row is copied that often and each of its facts meets one copy, chosen by the
    columns ``spread``, which therefore have to tell the facts of a key apart.
    The limit is ``task_rows``, or 1/``parts`` of all facts if that is more. Fewer
    than ``parts`` keys can be beyond it, whatever the data are, so their list may
    be broadcast; and no place holds more than about ``limit`` facts.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    # One pass over the counts: their sum, and the few that may be beyond the limit.
    large = F.when(F.col("n") > task_rows, F.struct(F.col(key).alias("k"), "n"))
    found = counts.agg(F.sum("n").alias("total"), F.collect_list(large).alias("large"))
    limit = F.greatest(F.lit(task_rows).cast("double"), F.col("total") / parts)
    hot = F.broadcast(
        found.select(limit.alias("limit"), F.explode("large").alias("x"))
        .where("x.n > limit")
        .select(F.col("x.k").alias("_hot_key"), F.ceil(F.col("x.n") / F.col("limit")).cast("int").alias("_places"))
    )
    places = F.coalesce("_places", F.lit(1))
    # From row content, not rand(): a re-run task must place its rows alike.
    salt = F.pmod(F.xxhash64(*spread), places).cast("int")
    if not null_matches:
        # Missing keys match nothing but still travel in a left join.
        salt = F.when(F.col(key).isNull(), F.hash(*spread)).otherwise(salt)
    is_hot = _same(F.col(key), F.col("_hot_key"), null_matches)
    left = (
        facts.join(hot, is_hot, "left")
        .withColumn("_salt", salt)
        .drop("_hot_key", "_places")
    )
    right = (
        dim.join(hot, is_hot, "left")
        .withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), places - 1)))
        .drop("_hot_key", "_places")
        .withColumnRenamed(key, "_dim_key")
    )
    on = _same(F.col(key), F.col("_dim_key"), null_matches) & (F.col("_salt") == F.col("_dim_salt"))
    return left.join(right, on, how).drop("_salt", "_dim_salt", "_dim_key")


def hot_key_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    *,
    how: str,
    spread: Sequence[str],
    counted: DataFrame | None = None,
    null_matches: bool = False,
    task_rows: int = TASK_ROWS,
    parts: int = PARTS,
) -> DataFrame:
    """``salted_join`` that counts the facts of each key first.

    ``counted`` may name a cheaper table with the same keys to count on.
    """
    rows = facts if counted is None else counted
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return salted_join(
        facts,
        dim,
        key,
        counts,
        how=how,
        spread=spread,
        null_matches=null_matches,
        task_rows=task_rows,
        parts=parts,
    )


def is_short(lookup: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> bool:
    """Whether a lookup has at most ``max_rows`` rows; counts no further than that."""
    return lookup.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    *,
    spread: Sequence[str],
    short: bool | None = None,
) -> DataFrame:
    """Left join to a lookup that is unique on ``key``, null matching null.

    The lookup is counted before it is broadcast, unless the caller did so; a
    longer one is joined by shuffle, with the facts of its frequent keys spread
    by ``spread``.
    """
    if not (is_short(lookup) if short is None else short):
        return hot_key_join(facts, lookup, key, how="left", spread=spread, null_matches=True)
    small = F.broadcast(lookup.withColumnRenamed(key, "_dim_key"))
    return facts.join(small, facts[key].eqNullSafe(small["_dim_key"]), "left").drop("_dim_key")
