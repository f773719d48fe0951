"""Ordered analytics that stay parallel when one key owns most of the rows.

A plain ``partitionBy(key).orderBy(t)`` window sorts a whole key in one task.
Here a key's axis is cut into slots: the window runs inside (key, slot), and the
edges are stitched from one summary row per slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import by_shuffle

_SLOT = "__slot"


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    slot: Column,
    prev: bool = True,
    following: bool = False,
    starts: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Adds ``prev_*`` / ``next_*`` of ``values`` and, with ``starts``, a ``run`` number.

    ``starts(row, previous)`` marks the rows that open a run; ``previous`` is NULL on a
    key's first row. Everything shares one summary per (key, slot), so the input is read
    twice however many of the outputs are asked for.
    """
    payload = F.struct(*[F.col(v) for v in values])
    when = F.struct(*[F.col(o) for o in order])
    inside = Window.partitionBy(*keys, _SLOT).orderBy(*[F.col(o) for o in order])
    local = df.withColumn(_SLOT, slot).withColumn("__p", F.lag(payload).over(inside))
    if following:
        local = local.withColumn("__n", F.lead(payload).over(inside))

    def opens(row: Column, before: Column) -> Column:
        return F.coalesce(starts(row, before), F.lit(False)).cast("bigint")

    # A slot's first row is judged after stitching, when its predecessor is known.
    stats = [F.min_by(payload, when).alias("__first"), F.max_by(payload, when).alias("__last")]
    if starts is not None:
        stats.append(F.sum(F.when(F.col("__p").isNotNull(), opens(payload, F.col("__p"))).otherwise(0)).alias("__inner"))
    across = Window.partitionBy(*keys).orderBy(_SLOT)
    edges = local.groupBy(*keys, _SLOT).agg(*stats)
    edges = edges.withColumns({"__cp": F.lag("__last").over(across), "__cn": F.lead("__first").over(across)})
    if starts is not None:
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.withColumn("__own", F.col("__inner") + opens(F.col("__first"), F.col("__cp")))
        edges = edges.withColumn("__base", F.coalesce(F.sum("__own").over(before), F.lit(0)))
    side = edges.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(_SLOT).alias("__ks"), "__cp", "__cn",
        *(["__base"] if starts is not None else []),
    )
    cond = F.col(_SLOT).eqNullSafe(F.col("__ks"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = local.join(side, cond, "left").withColumn("__p", F.coalesce("__p", "__cp"))
    out = [F.col(c) for c in df.columns]
    if starts is not None:
        so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__r", F.sum(opens(payload, F.col("__p"))).over(so_far))
        out.append((F.col("__r") + F.col("__base")).alias("run"))
    if prev:
        out += [F.col(f"__p.{v}").alias(f"prev_{v}") for v in values]
    if following:
        rows = rows.withColumn("__n", F.coalesce("__n", "__cn"))
        out += [F.col(f"__n.{v}").alias(f"next_{v}") for v in values]
    return rows.select(*out)


def previous_row(df: DataFrame, keys: list[str], order: list[str], values: list[str], slot: Column) -> DataFrame:
    return neighbours(df, keys, order, values, slot)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: Column, parts: int = 64) -> DataFrame:
    """First ``n`` rows per key: ranked in ``parts`` shares of each key, then once more."""
    share = F.pmod(F.xxhash64(spread), F.lit(parts))
    first = Window.partitionBy(*keys, share).orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__r", F.row_number().over(first))
        .where(F.col("__r") <= n)
        .withColumn("rank", F.row_number().over(second))
        .where(F.col("rank") <= n)
        .drop("__r")
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], slots: int = 64
) -> DataFrame:
    """Linear-interpolation quantiles per key, exact, without gathering a key in one task.

    Equal values collapse first. A mergeable sketch then gives cut points that
    split each key into slots of similar depth; slot counts place every wanted
    rank in one slot, and only those slots are sorted. Cut points and slots have rows
    per key, many for many keys, so neither is collected on the driver for a broadcast.
    """
    freq = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__x")).agg(F.count("*").alias("__n"))
    cuts = [i / slots for i in range(1, slots)]
    bounds = freq.groupBy(*keys).agg(
        F.percentile_approx("__x", cuts, 2000).alias("__cuts"), F.sum("__n").alias("__total")
    )
    slotted = by_shuffle(freq).join(bounds, keys).withColumn(
        _SLOT, F.size(F.filter("__cuts", lambda c: c < F.col("__x")))
    ).drop("__cuts")
    depth = slotted.groupBy(*keys, _SLOT).agg(F.sum("__n").alias("__depth"), F.first("__total").alias("__total"))
    before = Window.partitionBy(*keys).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    depth = depth.withColumn("__base", F.coalesce(F.sum("__depth").over(before), F.lit(0)))
    ranks = []
    for p in probs.values():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        ranks += [F.floor(pos), F.ceil(pos)]
    hit = None
    for r in ranks:
        c = (r >= F.col("__base")) & (r < F.col("__base") + F.col("__depth"))
        hit = c if hit is None else hit | c
    wanted = depth.where(hit).select(*keys, _SLOT, "__base")
    inside = Window.partitionBy(*keys, _SLOT).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        by_shuffle(slotted).join(wanted, [*keys, _SLOT])
        .withColumn("__hi", F.col("__base") + F.sum("__n").over(inside) - 1)
        .withColumn("__lo", F.col("__hi") - F.col("__n") + 1)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__lo")) & (rank <= F.col("__hi")), F.col("__x")))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        aggs += [at(F.floor(pos)).alias(f"__a_{name}"), at(F.ceil(pos)).alias(f"__b_{name}")]
    got = ranked.groupBy(*keys).agg(F.first("__total").alias("__total"), *aggs)
    out = [F.col(k) for k in keys]
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        w = pos - F.floor(pos)
        a, b = F.col(f"__a_{name}"), F.col(f"__b_{name}")
        out.append((a + (b - a) * w).alias(name))
    return got.select(*out)
