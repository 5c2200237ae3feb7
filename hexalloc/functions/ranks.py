"""Ranks and percentiles over whole tables without one task that sees them all.

A rank over a whole table is taken from counts of distinct values: values fall into ranges
(their bounds are approximate quantiles and only shape the work), each range sums up its
counts, and the ranges' totals, at most ``RANGES`` numbers a group, are summed up and joined
back by broadcast.  A small table is one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct rows that one range may hold, and ranges of a larger table.
SMALL_ROWS, RANGES = 200_000, 400
#: Values that an exact percentile may hold at once.
EXACT_ROWS = 2_000_000


def range_bounds(df: DataFrame, value: str, small: int = SMALL_ROWS) -> list[float]:
    """Bounds that cut the values into ranges; none for a small table."""
    shares = [k / RANGES for k in range(1, RANGES)]
    n, cuts = df.agg(F.count(value), F.percentile_approx(value, F.array(*map(F.lit, shares)), F.lit(10 * RANGES))).first()
    return sorted(set(cuts)) if n > small and cuts else []


def ranked_counts(df: DataFrame, value: str, groups: list[str] = (), small: int = SMALL_ROWS) -> DataFrame:
    """For each distinct value (in each group): how many rows have it, ``__n``, how many come
    before it in rising order, ``__before``, and how many there are, ``__all``."""
    groups = list(groups)
    bounds = range_bounds(df, value, small)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"))
    if not bounds and groups:
        w = Window.partitionBy(*groups).orderBy(value)
        return counts.withColumns({"__before": F.sum("__n").over(w) - F.col("__n"), "__all": F.sum("__n").over(Window.partitionBy(*groups))})
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value))) if bounds else F.lit(0)
    counts = counts.withColumn("__range", place)
    totals = counts.groupBy(*groups, "__range").agg(F.sum("__n").alias("__t"))
    w = Window.partitionBy(*groups).orderBy("__range")
    # At most RANGES rows for each group.
    totals = totals.withColumns({"__base": F.sum("__t").over(w) - F.col("__t"), "__all": F.sum("__t").over(Window.partitionBy(*groups))}).drop("__t")
    inside = F.sum("__n").over(Window.partitionBy(*groups, "__range").orderBy(value)) - F.col("__n")
    joined = counts.withColumn("__inside", inside).join(F.broadcast(totals) if not groups else totals, [*groups, "__range"])
    return joined.withColumn("__before", F.col("__base") + F.col("__inside")).drop("__base", "__inside", "__range")


def with_ranks(df: DataFrame, value: str, *, rank: str | None = None, mid: str | None = None, share: str | None = None, descending: bool = True, groups: list[str] = (), small: int = SMALL_ROWS, rows: int | None = None) -> DataFrame:
    """Adds ranks of a value; nulls have none.

    ``rank``: competition rank (1, 1, 3).  ``mid``: ranks shared by ties.  ``share``: the
    mid-rank in rising order, from 0 to 1 over all that have a value; 0 if there is one value.
    ``rows``: a bound of the rows of a group (of the table, without groups) where it is known;
    it is counted otherwise.  Up to ``small`` rows a group is ranked by a window.
    """
    groups = list(groups)
    if rows is None:
        counted = df.groupBy(*groups).count().agg(F.max("count")) if groups else df.agg(F.count(value))
        rows = counted.first()[0] or 0
    if rows <= small:
        w = Window.partitionBy(*groups)
        n, of_all = F.count(value).over(Window.partitionBy(*groups, value)), F.count(value).over(w)
        upward = F.rank().over(w.orderBy(F.asc_nulls_last(value)))
        order = F.rank().over(w.orderBy(F.desc_nulls_last(value))) if descending else upward
        there = F.col(value).isNotNull()
        new = {}
        if rank:
            new[rank] = F.when(there, order.cast("long"))
        if mid:
            new[mid] = F.when(there, order + (n - 1) / 2)
        if share:
            new[share] = F.when(there, F.when(n == of_all, 0.0).otherwise((upward - 1 + (n - 1) / 2) / (of_all - 1)))
        return df.withColumns(new)
    counts = ranked_counts(df, value, groups, small)
    before = (F.col("__all") - F.col("__before") - F.col("__n")) if descending else F.col("__before")
    new = {}
    if rank:
        new[rank] = (before + 1).cast("long")
    if mid:
        new[mid] = before + 1 + (F.col("__n") - 1) / 2
    if share:
        new[share] = F.when(F.col("__n") == F.col("__all"), 0.0).otherwise((F.col("__before") + (F.col("__n") - 1) / 2) / (F.col("__all") - 1))
    table = counts.select(*groups, value, *(c.alias(k) for k, c in new.items()))
    # Values and groups are equal or null together.
    on = [*groups, value]
    keys = table.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(on)), *new)
    match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) if k != value else F.col(k) == F.col(f"__k{i}") for i, k in enumerate(on)]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return df.join(keys, cond, "left").drop(*(f"__k{i}" for i in range(len(on))))


def total_order(df: DataFrame, first: str, second: str, name: str, rows: int, descending: bool = False, groups: list[str] = (), small: int = SMALL_ROWS) -> DataFrame:
    """Adds a whole number that orders rows by ``first`` (falling, if ``descending``) and then by the
    numeric ``second``, in each group of at most ``rows`` rows."""
    df = with_ranks(df, first, rank="__first", descending=descending, groups=groups, rows=rows, small=small)
    df = with_ranks(df, second, rank="__second", descending=False, groups=groups, rows=rows, small=small)
    return df.withColumn(name, F.col("__first") * (rows + 1) + F.col("__second")).drop("__first", "__second")


def running_sum(df: DataFrame, value: str, order: str, name: str, rows: int, groups: list[str] = (), small: int = SMALL_ROWS) -> DataFrame:
    """Adds the sum of ``value`` over a group's rows before, in rising order of a numeric column that
    is unique in it.  ``rows``: a bound of a group's rows; up to ``small`` a window sees them all,
    beyond it sums are taken in ranges, whose totals are summed up and joined back."""
    groups, zero = list(groups), F.lit(0)
    before = lambda w: F.coalesce(F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), zero)
    if rows <= small:
        return df.withColumn(name, before(Window.partitionBy(*groups) if groups else Window.partitionBy(zero)))
    bounds = range_bounds(df, order, small)
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else zero
    df = df.withColumn("__range", place)
    totals = df.groupBy(*groups, "__range").agg(F.sum(value).alias("__t"))
    w = Window.partitionBy(*groups, *([] if groups else [zero])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "__range", F.coalesce(F.sum("__t").over(w), zero).alias("__base"))
    inside = df.withColumn("__inside", before(Window.partitionBy(*groups, "__range")))
    return inside.join(totals, [*groups, "__range"]).withColumn(name, F.col("__base") + F.col("__inside")).drop("__base", "__inside", "__range")


def _interpolated(low: float, high: float, part: float) -> float:
    """As array libraries do it: from whichever end is nearer."""
    step = high - low
    return low + step * part if part < 0.5 else high - step * (1 - part)


def percentiles(df: DataFrame, wanted: dict[str, list[float]], exact_rows: int = EXACT_ROWS, rows: int | None = None) -> dict[str, list[float | None]]:
    """Exact percentiles with linear interpolation, of several columns at once.

    ``rows``: a bound of the rows where it is known.  Up to ``exact_rows`` one aggregate holds the values.  Beyond it, a value's place is
    narrowed down by approximate quantiles until what lies between two of them fits.
    """
    cols = list(wanted)
    if rows is not None and rows <= exact_rows:
        sizes = dict.fromkeys(cols, rows)
    else:
        row = df.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(cols))).first()
        sizes = {c: row[i] for i, c in enumerate(cols)}
    out: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in cols}
    easy = [c for c in cols if 0 < sizes[c] <= exact_rows]
    if easy:
        row = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, wanted[c]))).alias(f"p{i}") for i, c in enumerate(easy))).first()
        for i, c in enumerate(easy):
            out[c] = list(row[i]) if row[i] is not None else out[c]
    for c in cols:
        if sizes[c] > exact_rows:
            for k, p in enumerate(wanted[c]):
                at = (sizes[c] - 1) * p
                low = order_statistic(df, c, int(at), sizes[c], exact_rows)
                high = low if at == int(at) else order_statistic(df, c, int(at) + 1, sizes[c], exact_rows)
                out[c][k] = _interpolated(low, high, at - int(at))
    return out


def order_statistic(df: DataFrame, column: str, index: int, n: int, exact_rows: int) -> float:
    """The value at a place of the sorted column, from 0.

    Two approximate quantiles around the place are counted exactly; where the place turns out not
    to be between them, they are taken farther apart, at last as the least and the largest value."""
    part, before, apart = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), 0, 0.01
    while n > exact_rows:
        p = (index - before) / max(n - 1, 1)
        if apart >= 1:
            low, high = part.agg(F.min("v"), F.max("v")).first()
        else:
            low, high = part.agg(F.percentile_approx("v", F.array(F.lit(max(p - apart, 0.0)), F.lit(min(p + apart, 1.0))), F.lit(1000))).first()[0]
        below, equal_low, inside, equal_high = part.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") == low), F.count_if((F.col("v") > low) & (F.col("v") < high)), F.count_if(F.col("v") == high)).first()
        at = index - before - below
        if at < 0 or at >= equal_low + inside + (equal_high if high > low else 0):
            apart *= 8
            continue
        if at < equal_low:
            return low
        if at >= equal_low + inside:
            return high
        part, before, n, apart = part.where((F.col("v") > low) & (F.col("v") < high)), before + below + equal_low, inside, 0.01
    k = index - before
    return part.agg(F.percentile("v", F.lit(k / max(n - 1, 1)))).first()[0]


def nearest_rank(values: Column, q: float) -> Column:
    """Element at round-half-even((n - 1) * q) of a bounded array."""
    return F.element_at(F.array_sort(values), (F.rint((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def sorted_percentile(ordered: Column, q: float) -> Column:
    """Percentile with linear interpolation of a bounded sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.element_at(ordered, (F.floor(at) + 1).cast("int"))
    high = F.element_at(ordered, (F.ceil(at) + 1).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def lower_rank(values: Column, q: float) -> Column:
    """Element at floor((n - 1) * q) of a bounded array."""
    return F.element_at(F.array_sort(values), (F.floor((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def quintile(rank: Column, most: Column) -> Column:
    return F.least(F.greatest(F.ceil(rank / most * 5), F.lit(1)), F.lit(5)).cast("int")


def three_bands(rank: Column, most: Column) -> Column:
    return F.when(rank <= 0.2 * most, "high").when(rank <= 0.6 * most, "medium").otherwise("low")


def share_band(share: Column, most: Column) -> Column:
    """0 to 4 of the largest share; 0 where nothing is served."""
    return F.when(share > 0, F.least(F.lit(4), F.floor(share / most * 5 - 1e-9))).otherwise(0).cast("int")
