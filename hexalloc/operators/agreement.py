"""Agreement of rankings: correlations, concordance, intervals, permutation and bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, ranks


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; null where a side is constant (a plain ``corr`` divides
    by zero there)."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > 0) & (sb > 0), F.covar_pop(a, b) / (sa * sb))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``rho``, over rows that have both values; null where a side is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    both = ranks.with_ranks(ranks.with_ranks(both, a, mid="__a"), b, mid="__b")
    return both.agg(correlation("__a", "__b").alias("rho"))


def kendall(df: DataFrame, a: str, b: str, groups: list[str] = (), small: int = ranks.SMALL_ROWS) -> DataFrame:
    """``tau`` (b) of each group; null where a side is constant.  Rows without both values don't count.

    No pair is ever made.  With rows in the order of ``a`` (then ``b``), a pair disagrees where the
    larger rank of ``b`` comes first.  The two ranks are equal down to some bit, so for every bit
    the rows that are equal above it are walked in order, and a row without the bit meets as many
    disagreeing rows as have come with it: n log n rows, summed in ranges where groups are large."""
    groups = list(groups)
    g = groups or ["__whole"]
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.select(*groups, F.col(a).alias("__a"), F.col(b).alias("__b")) if groups else rows.select(F.lit(0).alias("__whole"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    most = rows.groupBy(*g).count().agg(F.max("count")).first()[0] or 0
    ranked = ranks.with_ranks(ranks.with_ranks(rows, "__a", rank="__ra", descending=False, groups=g, rows=most, small=small), "__b", rank="__rb", descending=False, groups=g, rows=most, small=small)
    cells = ranked.groupBy(*g, "__ra", "__rb").agg(F.count(F.lit(1)).alias("__n")).withColumn("__order", F.col("__ra") * (most + 1) + F.col("__rb"))

    def tied(*by):
        t = cells.groupBy(*g, *by).agg(F.sum("__n").alias("t")) if by else cells.groupBy(*g).agg(F.sum("__n").alias("t"))
        return t.groupBy(*g).agg(F.sum(F.expr("t * (t - 1) div 2")).alias("_".join(["pairs", *by])))

    bits = cells.withColumn("__bit", F.explode(F.sequence(F.lit(0), F.lit(max(most.bit_length() - 1, 0)))))
    bits = bits.withColumns({"__above": F.expr("shiftright(__rb, __bit + 1)"), "__has": F.expr("shiftright(__rb, __bit) & 1")}).withColumn("__ones", F.col("__n") * F.col("__has"))
    met = ranks.running_sum(bits, "__ones", "__order", "__met", most, [*g, "__bit", "__above"], small)
    against = met.groupBy(*g).agg(F.sum(F.when(F.col("__has") == 0, F.col("__n") * F.col("__met")).otherwise(0)).alias("against"))
    out = tied()
    for other in (tied("__ra"), tied("__rb"), tied("__ra", "__rb"), against):
        out = out.join(other, g)
    x, y = F.col("pairs") - F.col("pairs___ra"), F.col("pairs") - F.col("pairs___rb")
    s = F.col("pairs") - F.col("pairs___ra") - F.col("pairs___rb") + F.col("pairs___ra___rb") - 2 * F.col("against")
    return out.select(*groups, F.when((x > 0) & (y > 0), s / (F.sqrt(x.cast("double")) * F.sqrt(y.cast("double")))).alias("tau"))


def concordance(rankings: DataFrame, who: str, what: str, rank: str) -> DataFrame:
    """Kendall's W of respondents over the places that all of them ranked."""
    m = rankings.agg(F.count_distinct(who).alias("m"))
    totals = rankings.groupBy(what).agg(F.sum(rank).alias("t"), F.count_distinct(who).alias("k"))
    totals = totals.crossJoin(F.broadcast(m)).where("k = m")
    s = totals.agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"), (F.var_pop("t") * F.count(F.lit(1))).alias("s"))
    n, mm = F.col("n"), F.col("m")
    return s.select("n", "m", F.when(n > 1, 12 * F.col("s") / (mm * mm * (n * n * n - n))).alias("w"))


def consensus(rankings: DataFrame, who: str, what: str, rank: str) -> DataFrame:
    """Mean of the respondents' own mid-ranks over the places that all of them ranked."""
    m = rankings.agg(F.count_distinct(who).alias("__m"))
    common = rankings.groupBy(what).agg(F.count_distinct(who).alias("__k")).crossJoin(F.broadcast(m)).where("__k = __m").select(what)
    mine = ranks.with_ranks(rankings.join(common, what, "left_semi"), rank, mid="__mid", descending=False, groups=[who])
    return mine.groupBy(what).agg(F.avg("__mid").alias("mean_rank"))


def fisher(df: DataFrame, rho: str, n: str) -> DataFrame:
    low, high = numeric.fisher_interval(F.col(rho), F.col(n))
    return df.withColumns({"low": low, "high": high})


def _mid(x: np.ndarray) -> np.ndarray:
    """Mid-ranks of each row."""
    order = np.sort(x, axis=1)
    below = np.apply_along_axis(lambda r: np.searchsorted(r[: len(r) // 2], r[len(r) // 2 :], "left"), 1, np.hstack([order, x]))
    upto = np.apply_along_axis(lambda r: np.searchsorted(r[: len(r) // 2], r[len(r) // 2 :], "right"), 1, np.hstack([order, x]))
    return (below + upto + 1) / 2


def _rows_corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


#: Values that a block of draws holds at most (a draw of a larger group is a block), and draws that
#: have random numbers of their own, so that they can be made anywhere.
BLOCK_VALUES, CHUNK_DRAWS = 250_000, 500


def _doubled(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value was drawn, in each row, and its mid-rank, doubled and less the mean.
    ``counts``: of items by rising value; ``starts``: the first item of each value."""
    n = counts.shape[1]
    w = counts if len(starts) == n else np.add.reduceat(counts, starts, axis=1)
    return w, (2 * np.cumsum(w, axis=1) - w - n).astype(float)


def _drawn(x: np.ndarray, y: np.ndarray, draws: int, seed: list[int], block: int) -> tuple[np.ndarray, int]:
    """Correlations of resamples that have any, and how many shuffles agree as well as the items do.
    ``x`` and ``y``: places of each item's values among the distinct ones, by rising ``x``.

    A resample is how often each item was drawn, so its ranks are running sums over the items as they
    were sorted once: nothing is sorted anew."""
    n = len(x)
    by_y = np.argsort(y, kind="stable")
    from_x, from_y = (np.flatnonzero(np.r_[True, np.diff(v) > 0]) for v in (x, y[by_y]))
    whole = np.ones((1, n), np.int64)
    rx, ry = _doubled(whole, from_x)[1][0][x], _doubled(whole, from_y)[1][0][y]
    norm = np.linalg.norm(rx) * np.linalg.norm(ry)
    least = (rx @ ry) / norm - 1e-12
    picks, shuffles = (np.random.default_rng([*seed, k]) for k in (0, 1))
    found, hits = [], 0
    size = max(1, min(block, BLOCK_VALUES // n))
    for at in range(0, draws, size):
        k = min(size, draws - at)
        pick = picks.integers(0, n, (k, n))
        if k > 1:
            pick += np.arange(k)[:, None] * n
        counts = np.bincount(pick.ravel(), minlength=k * n).reshape(k, n)
        (wx, ax), (wy, ay) = _doubled(counts, from_x), _doubled(counts[:, by_y], from_y)
        both = np.sqrt(np.einsum("ij,ij,ij->i", wx, ax, ax) * np.einsum("ij,ij,ij->i", wy, ay, ay))
        ax = ax if len(from_x) == n else ax[:, x]
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.einsum("ij,ij,ij->i", counts, ax, ay[:, y]) / both
        found.append(c[np.isfinite(c)])
        shuffled = np.tile(ry, (k, 1))
        shuffles.permuted(shuffled, axis=1, out=shuffled)
        hits += int((shuffled @ rx / norm >= least).sum())
    return np.concatenate(found), hits


def resampled(df: DataFrame, group: str, model: str, expert: str, draws: int = 10_000, seed: int = 20260927, block: int = 500, apart: bool = False) -> DataFrame:
    """For each group: correlation, bootstrap interval, one-sided permutation p and draws used.

    A ranking of places that people made is small: its group is a task, which makes draws in blocks of
    ``block``, or fewer.  With ``apart`` a group may be of any size that a task can sort: its places in
    both orders go to many tasks, each of which makes ``CHUNK_DRAWS`` draws.  Chunks have random numbers
    of their own, so both ways give the same."""
    chunks = [(k, min(CHUNK_DRAWS, draws - k * CHUNK_DRAWS)) for k in range(-(-draws // CHUNK_DRAWS))]

    def places(pdf: pd.DataFrame) -> tuple[int, float, np.ndarray | None]:
        """Rows with both values, their correlation, and their places in both orders."""
        pdf = pdf.dropna(subset=[model, expert]).sort_values([model, expert])
        x, y = pdf[model].to_numpy(float), pdf[expert].to_numpy(float)
        if len(x) < 3 or np.ptp(x) == 0 or np.ptp(y) == 0:
            return len(x), np.nan, None
        return len(x), float(_rows_corr(_mid(x[None]), _mid(y[None]))[0]), np.stack([np.unique(v, return_inverse=True)[1] for v in (x, y)])

    def summed(name, n: int, rho: float, parts: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
        if not parts:
            return pd.DataFrame({"g": name, "n": [n] if n else [], "rho": np.nan, "low": np.nan, "high": np.nan, "p": np.nan, "draws": 0})
        found, hits = np.concatenate([f for f, _ in parts]), sum(h for _, h in parts)
        low, high = np.percentile(found, [2.5, 97.5])
        return pd.DataFrame({"g": name, "n": [n], "rho": [rho], "low": [low], "high": [high], "p": [(hits + 1) / (draws + 1)], "draws": [len(found)]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, rho, at = places(pdf)
        return summed(pdf[group].iloc[: min(n, 1)].to_numpy(), n, rho, [] if at is None else [_drawn(*at, size, [seed, k], block) for k, size in chunks])

    kind = df.schema[group].dataType.simpleString()
    result = f"g {kind}, n long, rho double, low double, high double, p double, draws long"
    rows = df.select(group, model, expert).groupBy(group)
    if not apart:
        return rows.applyInPandas(run, result).withColumnRenamed("g", group)

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        n, rho, at = places(pdf)
        return pd.DataFrame({"g": pdf[group].iloc[:1].to_numpy(), "n": [n], "rho": [rho], "at": [None if at is None else at.astype(np.int32).tobytes()]})

    def draw(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                got, hits = _drawn(*np.frombuffer(r.at, np.int32).reshape(2, -1), chunks[r.chunk][1], [seed, r.chunk], block) if r.at is not None else (np.empty(0), -1)
                yield pd.DataFrame({"g": [r.g], "n": [r.n], "rho": [r.rho], "found": [got], "hits": [hits]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        return summed(pdf["g"].iloc[: min(n, 1)].to_numpy(), n, pdf["rho"].iloc[0], [(np.asarray(f), int(h)) for f, h in zip(pdf["found"], pdf["hits"]) if h >= 0])

    sorted_ = rows.applyInPandas(sort, f"g {kind}, n long, rho double, at binary")
    each = sorted_.withColumn("chunk", F.explode(F.when(F.col("at").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))))
    tasks = max(100, df.sparkSession.sparkContext.defaultParallelism)
    made = each.repartition(tasks).mapInPandas(draw, f"g {kind}, n long, rho double, found array<double>, hits long")
    return made.groupBy("g").applyInPandas(merge, result).withColumnRenamed("g", group)


def of_respondents(rankings: DataFrame, who: str, expert: str, model: str) -> DataFrame:
    """``who, n, rho`` of each respondent's ranking against the model's; null where either is
    constant, which makes an agreement undefined."""
    both = rankings.where(F.col(expert).isNotNull() & F.col(model).isNotNull()).select(who, F.col(expert).alias("__x"), F.col(model).alias("__y"))
    both = ranks.with_ranks(both, "__x", mid="__a", descending=False, groups=[who])
    both = ranks.with_ranks(both, "__y", mid="__b", descending=False, groups=[who])
    return both.groupBy(who).agg(F.count(F.lit(1)).alias("n"), correlation("__a", "__b").alias("rho"))


def of_resamples(rows: DataFrame, picks: DataFrame, group: str, item: str, x: str, y: str, resample: str = "resample") -> DataFrame:
    """``group, resample, rho``: both columns ranked anew within each resample.  ``picks``: group,
    resample and item, an item as often as it was drawn; resamples in which a side is constant go."""
    drawn = picks.join(rows.select(group, item, F.col(x).alias("__x"), F.col(y).alias("__y")), [group, item])
    drawn = ranks.with_ranks(drawn, "__x", mid="__a", descending=False, groups=[group, resample])
    drawn = ranks.with_ranks(drawn, "__y", mid="__b", descending=False, groups=[group, resample])
    return drawn.groupBy(group, resample).agg(correlation("__a", "__b").alias("rho")).where("rho is not null")
