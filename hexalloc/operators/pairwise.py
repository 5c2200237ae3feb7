"""Weights from pairwise judgements: eigenvector, consistency, conflicting judgements."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Random index by number of items, and the ratio that is still acceptable.
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}


def threshold(n: int) -> float:
    return {3: 0.05, 4: 0.08}.get(n, 0.10)


def matrix(answers: DataFrame, i: str = "i", j: str = "j", a: str = "a") -> DataFrame:
    """``i, j, a`` of the whole reciprocal matrix: answers, their reciprocals and the diagonal."""
    bad = answers.where((F.col(a) <= 0) | F.col(a).isNull() | (F.col(i) == F.col(j))).limit(1).collect()
    if bad:
        raise ValueError(f"a judgement must be above 0 and between two items: {bad[0].asDict()}")
    given = answers.select(F.col(i).cast("int").alias("i"), F.col(j).cast("int").alias("j"), F.col(a).cast("double").alias("a"))
    items = given.select("i").union(given.select("j")).distinct()
    return given.union(given.select(F.col("j"), F.col("i"), 1 / F.col("a"))).union(items.select("i", F.col("i").alias("j"), F.lit(1.0)))


def evaluate(whole: DataFrame, tolerance: float = 1e-12, steps: int = 1000) -> dict:
    """Weights and consistency of one matrix. Its items are a handful, so it is read once."""
    rows = whole.collect()
    items = sorted({r.i for r in rows})
    n, at = len(items), {x: k for k, x in enumerate(items)}
    m = [[None] * n for _ in items]
    for r in rows:
        m[at[r.i]][at[r.j]] = r.a
    if any(x is None for row in m for x in row):
        raise ValueError("a pair has no judgement")
    for p in range(n):
        for q in range(n):
            if abs(m[p][q] * m[q][p] - 1) > 1e-9:
                raise ValueError(f"items {items[p]} and {items[q]} are not reciprocal")
    w = [1 / n] * n
    for _ in range(steps):
        v = [sum(m[p][q] * w[q] for q in range(n)) for p in range(n)]
        total = sum(v)
        v = [x / total for x in v]
        moved = max(abs(x - y) for x, y in zip(v, w))
        w = v
        if moved < tolerance:
            break
    ratios = [sum(m[p][q] * w[q] for q in range(n)) / w[p] for p in range(n)]
    top = sum(ratios) / n
    if top < n - 1e-9:
        raise ValueError("the largest eigenvalue is below the number of items")
    ci = max((top - n) / (n - 1), 0.0) if n > 1 else 0.0
    if n not in RANDOM_INDEX:
        raise ValueError(f"no random index for {n} items")
    out = {"items": items, "weights": w, "lambda_max": top, "ci": ci, "cr": ci / RANDOM_INDEX[n] if RANDOM_INDEX[n] else 0.0, "bracket": (min(ratios), max(ratios)), "threshold": threshold(n)}
    if n == 3:
        out["kappa"] = m[0][1] * m[1][2] / m[0][2]
    return out


def weights_sql(spark: SparkSession, whole: DataFrame, doublings: int = 60) -> DataFrame:
    """``i, w`` by power iteration as a recursive query: nothing leaves the engine.

    Each step squares the matrix (and scales it to a sum of 1), so that k steps are 2^k iterations;
    it ends when no weight moves by 1e-12, which ``doublings`` are more than enough for."""
    name = f"pairwise_{uuid.uuid4().hex}"
    whole.createOrReplaceTempView(name)
    square = "transform(sequence(0, n * n - 1), x -> aggregate(sequence(0, n - 1), 0D, (s, q) -> s + a[x div n * n + q] * a[q * n + x % n]))"
    scaled = f"transform({square}, v -> v / aggregate({square}, 0D, (s, y) -> s + y))"
    weights = "transform(sequence(0, n - 1), p -> aggregate(slice({a}, p * n + 1, n), 0D, (s, y) -> s + y) / aggregate({a}, 0D, (s, y) -> s + y))"
    return spark.sql(f"""
        WITH RECURSIVE start AS (SELECT array_sort(collect_set(i)) AS ids, cast(count(DISTINCT i) AS int) AS n, transform(array_sort(collect_list(struct(i, j, a))), x -> x.a) AS a FROM {name}),
        steps(k, ids, n, a, w, moved) AS (
            SELECT 0, ids, n, a, {weights.format(a="a")}, 1D FROM start
            UNION ALL
            SELECT k + 1, ids, n, b, {weights.format(a="b")}, array_max(transform(sequence(0, n - 1), p -> abs(aggregate(slice(b, p * n + 1, n), 0D, (s, y) -> s + y) / aggregate(b, 0D, (s, y) -> s + y) - w[p])))
            FROM (SELECT k, ids, n, w, moved, {scaled} AS b FROM steps WHERE k < {doublings} AND moved >= 1e-12))
        SELECT id AS i, w[pos] AS w FROM (SELECT max_by(ids, k) AS ids, max_by(w, k) AS w FROM steps) LATERAL VIEW posexplode(ids) t AS pos, id""")


def conflicts(whole: DataFrame, weights: DataFrame) -> DataFrame:
    """Judgements by how far they are from what the weights imply, the farthest first."""
    wi, wj = weights.select(F.col("i"), F.col("w").alias("wi")), weights.select(F.col("i").alias("j"), F.col("w").alias("wj"))
    out = whole.where("i < j").join(F.broadcast(wi), "i").join(F.broadcast(wj), "j")
    error = F.col("a") * F.col("wj") / F.col("wi")
    return out.select("i", "j", "a", (F.col("wi") / F.col("wj")).alias("implied"), F.greatest(error, 1 / error).alias("error")).orderBy(F.desc("error"), F.desc("i"), F.desc("j"))


def shared_inconsistency(errors: list[float], tolerance: float = 1e-6) -> bool:
    return len(errors) < 2 or max(errors) - min(errors) <= tolerance * max(errors)


def three_items(a01: float, a02: float, a12: float) -> list[float]:
    """Weights of three items: the rows' geometric means."""
    g = [(a01 * a02) ** (1 / 3), (a12 / a01) ** (1 / 3), (1 / (a02 * a12)) ** (1 / 3)]
    return [x / math.fsum(g) for x in g]


def consistency(whole: DataFrame, weights: DataFrame) -> DataFrame:
    """One row of a judged matrix: ``n, lambda_max, ci, cr, threshold, low, high``, where low and high
    are the least and the largest of (A w)_i / w_i, which hold the eigenvalue between them."""
    w = weights.select(F.col("i").alias("j"), F.col("w").alias("wj"))
    ratio = whole.join(F.broadcast(w), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("wj")).alias("s")).join(F.broadcast(weights), "i").select((F.col("s") / F.col("w")).alias("r"))
    one = ratio.agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("lambda_max"), F.min("r").alias("low"), F.max("r").alias("high"))
    n = F.col("n")
    index = F.element_at(F.create_map(*(F.lit(x) for pair in RANDOM_INDEX.items() for x in pair)), n.cast("int"))
    one = one.withColumn("ci", F.when(n > 1, F.greatest((F.col("lambda_max") - n) / (n - 1), F.lit(0.0))).otherwise(0.0))
    limit = F.when(n == 3, threshold(3)).when(n == 4, threshold(4)).otherwise(threshold(5))
    return one.select("n", "lambda_max", "ci", F.when(index > 0, F.col("ci") / index).otherwise(0.0).alias("cr"), limit.alias("threshold"), "low", "high")


def session(spark: SparkSession, items: list[str], ask: Callable[[str, str], float], rounds: int = 5) -> dict:
    """Asks for every pair of items, and again for the pair that stands out most, until the answers are
    consistent enough or the rounds are over.  ``ask`` is told two items and gives how many times
    as much the first counts.  Returns the evaluation, the answers and how often it asked again."""
    pairs = [(i, j) for i in range(len(items)) for j in range(i + 1, len(items))]
    answers, times = {p: float(ask(items[p[0]], items[p[1]])) for p in pairs}, dict.fromkeys(pairs, 1)
    for turn in range(rounds + 1):
        whole = matrix(spark.createDataFrame([(i, j, a) for (i, j), a in answers.items()], "i int, j int, a double"))
        found = evaluate(whole)
        if found["cr"] <= found["threshold"] or turn == rounds:
            return found | {"answers": {(items[i], items[j]): a for (i, j), a in answers.items()}, "asked_again": turn, "consistent": found["cr"] <= found["threshold"]}
        # Of pairs that stand out alike (of three items all do) the one that was asked least.
        error = {p: round(abs(math.log(answers[p] * found["weights"][p[1]] / found["weights"][p[0]])), 9) for p in pairs}
        worst = max(pairs, key=lambda p: (error[p], -times[p], p))
        times[worst] += 1
        answers[worst] = float(ask(items[worst[0]], items[worst[1]]))
