"""Rank uncertainty: priorities under drawn weights, and what a cell's ranks do."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ranks
from ..functions.numeric import rint_to
from .index import Model, normalised

# Fixed values of the uncertainty model.
SEED, DRAWS, CONCENTRATION = 20260926, 1000, 50.0
TOP_SHARE, HIGH, MEDIUM = 0.2, 0.8, 0.5
ALTERNATIVES = ("robust_minmax", "percentile_rank")


def draw_weights(inner: dict[str, float], outer: dict[str, float], n: int = DRAWS, seed: int = SEED, alpha: float = CONCENTRATION, methods: tuple[str, ...] = ALTERNATIVES) -> list[tuple]:
    """Rows ``draw, method, w_<inner>..., e_<outer>...``: Dirichlet draws around the weights.

    One generator gives the inner weights and then the exponents of every draw, in turn;
    methods alternate, so each gets the same number of draws."""
    rng = np.random.default_rng(seed)
    a, b = alpha * np.array(list(inner.values())), alpha * np.array(list(outer.values()))
    return [(k, methods[k % len(methods)], *map(float, rng.dirichlet(a)), *map(float, rng.dirichlet(b))) for k in range(n)]


def draws_table(spark: SparkSession, rows: list[tuple], inner: list[str], outer: list[str]) -> DataFrame:
    fields = [T.StructField("draw", T.IntegerType()), T.StructField("method", T.StringType())]
    fields += [T.StructField(n, T.DoubleType()) for n in [f"w_{i}" for i in inner] + [f"e_{o}" for o in outer]]
    return spark.createDataFrame(rows, T.StructType(fields))


def both_methods(df: DataFrame, model: Model, key: str, methods: tuple[str, ...] = ALTERNATIVES) -> DataFrame:
    """The normalised table once for each method, made once for all draws."""
    from dataclasses import replace

    parts = []
    for m in methods:
        t, here, _, _ = normalised(df, replace(model, method=m))
        parts.append(t.select(key, F.lit(m).alias("method"), *(f"{i.column}_n" for i in here)))
    return reduce(DataFrame.unionByName, parts)


def drawn_priorities(norm: DataFrame, draws: DataFrame, key: str, single: dict[str, str], mixed: str, inner: list[str], floors: dict[str, float | None]) -> DataFrame:
    """``key, draw, method, priority``. ``single``: dimensions of one indicator; ``mixed``: the
    dimension whose indicators are weighed anew in every draw."""
    joined = norm.join(F.broadcast(draws), "method")

    def floored(c: Column, d: str) -> Column:
        c = F.coalesce(c, F.lit(0.0))
        return F.greatest(c, F.lit(floors[d])) if floors.get(d) is not None else c

    parts = {d: floored(F.col(f"{c}_n"), d) for d, c in single.items()}
    parts[mixed] = floored(reduce(lambda x, y: x + y, (F.col(f"w_{i}") * F.coalesce(F.col(f"{i}_n"), F.lit(0.0)) for i in inner)), mixed)
    logs = reduce(lambda x, y: x + y, (F.col(f"e_{d}") * F.ln(c) for d, c in parts.items()))
    return joined.select(key, "draw", "method", F.when(F.least(*parts.values()) <= 0, 0.0).otherwise(F.exp(logs)).alias("priority"))


def drawn_ranks(priorities: DataFrame, digits: int = 12, cells: int | None = None) -> DataFrame:
    """Adds the competition rank within each draw (of ``cells`` rows)."""
    p = priorities.withColumn("__p", F.round("priority", digits))
    return ranks.with_ranks(p, "__p", rank="rank", groups=["draw"], rows=cells).drop("__p")


def summary(ranked: DataFrame, key: str, cells: int, draws: int, methods: tuple[str, ...] = ALTERNATIVES) -> DataFrame:
    """What each cell's ranks do over all draws (a bounded number for each cell)."""
    hit = (F.col("rank") <= int(np.ceil(TOP_SHARE * cells))).cast("int")
    aggs = [
        F.avg(hit).alias("p"),
        F.array_sort(F.collect_list("rank")).alias("ranks"),
        F.array_sort(F.collect_list("priority")).alias("priorities"),
        *(F.avg(F.when(F.col("method") == m, hit)).alias(f"p_{m}_raw") for m in methods),
    ]
    return described(ranked.groupBy(key).agg(*aggs), draws, methods)


#: Cells whose normalised values are sent to all workers, and cells whose ranks of all draws are put
#: together at a time.
BROADCAST_CELLS, RANGE_CELLS = 2_000_000, 8_000


def drawn_summary(norm: DataFrame, draws: DataFrame, key: str, single: dict[str, str], mixed: str, inner: list[str], floors: dict[str, float | None], cells: int, methods: tuple[str, ...] = ALTERNATIVES, most: int = BROADCAST_CELLS, digits: int = 12, range_cells: int = RANGE_CELLS) -> DataFrame:
    """``summary`` of all draws, from the normalised table of both methods.

    Up to ``most`` cells (2**24 at most) the table goes to every worker.  A draw's ranks are made as one
    array, and of it parts travel to the ranges of ``range_cells`` cells that they are about: two bytes
    a rank, and what stands above them compressed, as cells lie in the order of a plain priority.
    Priorities don't travel; a range makes those of its own cells again.  More cells are ranked draw by
    draw."""
    n = draws.count()
    if cells > min(most, 2**24):
        ranked = drawn_ranks(drawn_priorities(norm, draws, key, single, mixed, inner, floors), digits, cells)
        return summary(ranked, key, cells, n, methods)
    spark = norm.sparkSession
    sent, priorities = held_values(norm, key, single, mixed, inner, floors, methods)
    weights = [r.asDict() for r in draws.orderBy("draw").collect()]

    def rank(batches):
        for b in batches:
            for at in b.column("at").to_pylist():
                p = np.round(priorities(weights[at], slice(None)), digits)
                order = np.argsort(p)
                rising = p[order]
                # Of equal priorities all have the rank of the last in rising order.
                last = np.flatnonzero(np.r_[rising[1:] != rising[:-1], True])
                place = np.empty(len(p), np.int32)
                place[order] = np.repeat(len(p) - last, np.diff(last, prepend=-1)).astype(np.int32)
                starts = range(0, len(p), range_cells)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([at] * len(starts), pa.int32()), pa.array([packed(place[k : k + range_cells]) for k in starts], pa.binary())], names=["part", "at", "ranks"])

    top = int(np.ceil(TOP_SHARE * cells))
    using = {m: [k for k, w in enumerate(weights) if w["method"] == m] for m in methods}
    low, high = (int(np.rint((n - 1) * q)) for q in (0.05, 0.95))
    numbers = ["p", "median", "priority_low_raw", "priority_high_raw", *(f"p_{m}_raw" for m in methods)]
    schema = T.StructType([norm.schema[key], T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in numbers)])

    def put_together(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        some = slice(part * range_cells, (part + 1) * range_cells)
        names = sent.value["keys"][some.start : some.stop]
        ranks_ = np.empty((n, len(names)), np.int32)
        for chunk in rows.select(["at", "ranks"]).to_batches():
            for at, r in zip(chunk.column(0).to_pylist(), chunk.column(1)):
                ranks_[at] = unpacked(r.as_buffer(), len(names))
        hit = ranks_ <= top
        shares = {m: hit[k].mean(0) if k else np.full(len(names), np.nan) for m, k in using.items()}
        p = hit.mean(0)
        ranks_ = np.sort(ranks_, axis=0)
        values = np.stack([priorities(w, some) for w in weights])
        values.partition(sorted({k for q in (0.05, 0.95) for k in ends(n, q)[:2]}), axis=0)
        out = [names, ranks_[low], ranks_[high], p, at_share(ranks_, 0.5), at_share(values, 0.05), at_share(values, 0.95), *(pa.array(shares[m], from_pandas=True) for m in methods)]
        return pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], names=[f.name for f in schema])

    ranges = max(1, -(-cells // range_cells))
    made = numbered(spark, n).mapInArrow(rank, "part int, at int, ranks binary").repartition(min(ranges, 4_000), "part")
    out = made.groupBy("part").applyInArrow(put_together, schema)
    return graded(out.select(
        key,
        "p",
        F.col("median").cast("long").alias("median_rank"),
        F.col("low").cast("long").alias("rank_low"),
        F.col("high").cast("long").alias("rank_high"),
        (F.col("high") - F.col("low")).cast("long").alias("rank_width"),
        "priority_low_raw",
        "priority_high_raw",
        *(f"p_{m}_raw" for m in methods),
    ), n, methods)


def held_values(norm: DataFrame, key: str, single: dict[str, str], mixed: str, inner: list[str], floors: dict[str, float | None], methods: tuple[str, ...]):
    """The normalised table of both methods, sent to every worker as arrays in the order of a plain
    priority, and a function that makes from it the priorities of a draw for some of the cells."""
    parts = [*single, mixed]
    columns = sorted({*single.values(), *inner})
    held = {}
    for m in methods:
        got = norm.where(F.col("method") == m).select(key, *(F.coalesce(f"{c}_n", F.lit(0.0)).cast("double").alias(c) for c in columns)).toArrow()
        order = pc.sort_indices(got[key])
        held["keys"] = got[key].take(order).combine_chunks()
        values = {c: got[c].to_numpy()[order.to_numpy()] for c in columns}
        # Logarithms of dimensions that no draw changes are taken once.
        held[m] = {d: lifted(values[c], floors.get(d)) for d, c in single.items()}, {i: values[i] for i in inner}
    first = held[methods[0]]
    plain = np.argsort(sum(v for v, _ in first[0].values()) + lifted(sum(first[1].values()), floors.get(mixed))[0], kind="stable")
    held = {"keys": held["keys"].take(pa.array(plain)), **{m: ({d: (v[plain], z[plain]) for d, (v, z) in held[m][0].items()}, {i: v[plain] for i, v in held[m][1].items()}) for m in methods}}
    sent = norm.sparkSession.sparkContext.broadcast(held)

    def priorities(draw: dict, some: slice) -> np.ndarray:
        lifts, mixing = sent.value[draw["method"]]
        lifts = {d: (v[some], z[some]) for d, (v, z) in lifts.items()}
        lifts[mixed] = lifted(sum(draw[f"w_{i}"] * mixing[i][some] for i in inner), floors.get(mixed))
        p = np.exp(sum(draw[f"e_{d}"] * lifts[d][0] for d in parts))
        p[reduce(np.logical_or, (lifts[d][1] for d in parts))] = 0.0
        return p

    return sent, priorities


def numbered(spark: SparkSession, n: int) -> DataFrame:
    """Numbers of draws, ``at``, dealt to many tasks."""
    out = spark.range(n).select(F.col("id").cast("int").alias("at"))
    return out.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)), "at") if n else out


def drawn_stability(norm: DataFrame, draws: DataFrame, key: str, single: dict[str, str], mixed: str, inner: list[str], floors: dict[str, float | None], cells: int, methods: tuple[str, ...] = ALTERNATIVES, most: int = BROADCAST_CELLS, digits: int = 12, range_cells: int = RANGE_CELLS) -> DataFrame:
    """``key, p_top20, stability`` of ``drawn_summary`` alone: no ranks are made, sorted or sent.

    A cell is in a draw's highest fifth if its priority is not below the last one of it.  A task counts
    that over its draws, and counts travel, two bytes for each cell and task.  More than ``most`` cells
    are ranked draw by draw."""
    n, top = draws.count(), int(np.ceil(TOP_SHARE * cells))
    if cells > most:
        ranked = drawn_ranks(drawn_priorities(norm, draws, key, single, mixed, inner, floors), digits, cells)
        out = ranked.groupBy(key).agg(F.avg((F.col("rank") <= top).cast("int")).alias("p"))
    else:
        sent, priorities = held_values(norm, key, single, mixed, inner, floors, methods)
        weights = [r.asDict() for r in draws.orderBy("draw").collect()]
        width = np.uint16 if n < 2**16 else np.uint32

        def count(batches):
            hits = None
            for b in batches:
                for at in b.column("at").to_pylist():
                    p = np.round(priorities(weights[at], slice(None)), digits)
                    p[np.isnan(p)] = np.inf
                    hits = np.zeros(len(p), width) if hits is None else hits
                    if len(p):
                        hits += p >= np.partition(p, len(p) - top)[len(p) - top]
            if hits is not None:
                starts = range(0, len(hits), range_cells)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([hits[k : k + range_cells].tobytes() for k in starts], pa.binary())], names=["part", "hits"])

        schema = T.StructType([norm.schema[key], T.StructField("p", T.DoubleType())])

        def put_together(rows: pa.Table) -> pa.Table:
            at = rows.column("part")[0].as_py() * range_cells
            hits = sum(np.frombuffer(h.as_buffer(), width).astype(np.int64) for h in rows.column("hits"))
            return pa.table([sent.value["keys"][at : at + range_cells], pa.array(hits / n)], names=[key, "p"])

        made = numbered(norm.sparkSession, n).mapInArrow(count, "part int, hits binary")
        out = made.groupBy("part").applyInArrow(put_together, schema)
    return out.select(key, rint_to(F.col("p"), 2).alias("p_top20")).withColumn("stability", stable(F.col("p_top20")))


def packed(ranks_: np.ndarray) -> bytes:
    """Ranks below 2**24: their two lower bytes, then the upper one compressed."""
    return ranks_.astype(np.uint16).tobytes() + pa.compress((ranks_ >> 16).astype(np.uint8).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    upper = pa.decompress(data.slice(2 * n), decompressed_size=n, codec="zstd")
    return np.frombuffer(upper, np.uint8).astype(np.int32) << 16 | np.frombuffer(data.slice(0, 2 * n), np.uint16)


def lifted(values: np.ndarray, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of a dimension's values, and where there is nothing to take one of."""
    v = values if floor is None else np.maximum(values, floor)
    return np.log(np.maximum(v, 1e-300)), v <= 0


def ends(n: int, share: float) -> tuple[int, int, float]:
    """Places of a percentile's two neighbours among ``n`` sorted values, and its way between them."""
    at = (n - 1) * share
    low = int(np.floor(at))
    return low, min(low + 1, n - 1), at - low


def at_share(rows: np.ndarray, share: float) -> np.ndarray:
    """The percentile of each column, whose rows stand where sorting puts them."""
    low, high, way = ends(len(rows), share)
    a, b = rows[low].astype(float), rows[high].astype(float)
    return a + (b - a) * way


def described(out: DataFrame, draws: int, methods: tuple[str, ...]) -> DataFrame:
    """Columns of a summary from a cell's sorted ranks and priorities and its shares of hits."""
    low, high = (F.element_at("ranks", (F.rint((F.size("ranks") - 1) * F.lit(q)) + 1).cast("int")) for q in (0.05, 0.95))
    out = out.withColumns({
        "median_rank": ranks.sorted_percentile(F.col("ranks"), 0.5).cast("long"),
        "rank_low": low.cast("long"),
        "rank_high": high.cast("long"),
        "rank_width": (high - low).cast("long"),
        "priority_low_raw": ranks.sorted_percentile(F.col("priorities"), 0.05),
        "priority_high_raw": ranks.sorted_percentile(F.col("priorities"), 0.95),
    })
    return graded(out.drop("ranks", "priorities"), draws, methods)


def graded(out: DataFrame, draws: int, methods: tuple[str, ...]) -> DataFrame:
    """Rounds a summary's numbers, and adds what follows from them."""
    out = out.withColumns({
        "priority_low": rint_to(F.col("priority_low_raw"), 3),
        "priority_high": rint_to(F.col("priority_high_raw"), 3),
        "p_top20": rint_to(F.col("p"), 2),
        "p_top20_se": rint_to(F.sqrt(F.col("p") * (1 - F.col("p")) / draws), 3),
        **{f"p_{m}": rint_to(F.col(f"p_{m}_raw"), 2) for m in methods},
        "method_gap": rint_to(F.abs(F.col(f"p_{methods[0]}_raw") - F.col(f"p_{methods[1]}_raw")), 2),
    })
    # Classes go by the rounded numbers, as they are shown.
    p = F.col("p_top20")
    out = out.withColumn("certainty", rint_to(F.greatest(p, 1.0 - p), 2))
    out = out.withColumns({"stability": stable(p), "confidence": grade(F.col("certainty")), "confidence_literal": grade(p)})
    return out.drop("p", "priority_low_raw", "priority_high_raw", *(f"p_{m}_raw" for m in methods))


def stable(p: Column) -> Column:
    """Class of a rounded share of draws in the highest fifth."""
    return F.when(p >= HIGH, "confidently in").when(p <= 1 - HIGH, "confidently out").otherwise("uncertain")


def grade(x: Column) -> Column:
    return F.when(x >= HIGH, "high").when(x >= MEDIUM, "medium").otherwise("low")
