"""ROC curves, their areas, and a random search for the polynomial. Scores are (metric, name, positive boolean, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranges(scores: DataFrame) -> DataFrame:
    """(metric, min, range)."""
    return scores.groupBy("metric").agg(F.min("score").alias("min"), (F.max("score") - F.min("score")).alias("range"))


def scaled(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Scores as (score - min) / range; a metric without limits or of range 0 raises."""
    known = F.when(F.col("range").isNull(), F.raise_error(F.concat(F.lit("no range of "), F.col("metric"))).cast("double")).when(F.col("range") == 0, F.raise_error(F.concat(F.lit("range 0 of "), F.col("metric"))).cast("double")).otherwise(F.col("range"))
    met = scores.join(F.broadcast(limits.select("metric", "min", "range")), "metric", "left")
    return met.select(*[c for c in scores.columns if c != "score"], ((F.col("score") - F.col("min")) / known).alias("score"))


def roc(scores: DataFrame) -> DataFrame:
    """(metric, pos, score, tpr, fpr): a point for each different score, best first, after (0, 0) at pos 0.

    Scores are counted before they are sorted, so a window only sees different values.
    """
    counts = scores.groupBy("metric", "score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n"))
    down = Window.partitionBy("metric").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("metric")
    rate = lambda c: F.sum(c).over(down) / F.nullif(F.sum(c).over(every), F.lit(0))
    points = counts.select("metric", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("score"))).alias("pos"), "score", rate("p").alias("tpr"), rate("n").alias("fpr"))
    first = scores.select("metric").distinct().select("metric", F.lit(0).alias("pos"), F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return first.unionByName(points)


def auc(points: DataFrame) -> DataFrame:
    """(metric, auc, auc_swapped): the area under the curve, and that with exchanged axes, by trapezoids."""
    w = Window.partitionBy("metric").orderBy("pos")
    prev = points.select("metric", "tpr", "fpr", F.lag("tpr").over(w).alias("t0"), F.lag("fpr").over(w).alias("f0"))
    area = F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2)
    swapped = F.sum((F.col("tpr") - F.col("t0")) * (F.col("fpr") + F.col("f0")) / 2)
    return prev.groupBy("metric").agg(area.alias("auc"), swapped.alias("auc_swapped"))


def report(scores: DataFrame, above: bool = False) -> DataFrame:
    """(metric, auc, points) per metric; above: with the sign of scores turned where the area is under a half."""
    points = roc(scores)
    if above:
        low = auc(points).where("auc < 0.5").select("metric", F.lit(-1.0).alias("sign"))
        points = roc(scores.join(F.broadcast(low), "metric", "left").withColumn("score", F.col("score") * F.coalesce("sign", F.lit(1.0))).drop("sign"))
    listed = points.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("fpr").alias("x"), F.col("tpr").alias("y")))).alias("l"))
    return auc(points).join(listed, "metric").select("metric", "auc", F.transform("l", lambda p: F.struct(p["x"], p["y"])).alias("points"))


#: Rows of scores up to which each candidate's area is exact; more are counted in bins.
EXACT, BINS = 200_000, 4096


def _scores(logs: np.ndarray, known: np.ndarray | None, coef: np.ndarray, power: np.ndarray) -> np.ndarray:
    """A candidate's scores, of logarithms of scaled scores by metric; unknown ones add nothing, powers are 1e6 at most."""
    total = np.zeros(logs.shape[1])
    for k in range(len(logs)):
        x = logs[k] * power[k]
        np.exp(x, out=x)
        np.minimum(x, 1e6, out=x)
        x *= coef[k]
        if known is not None:
            x[~known[k]] = 0.0
        total += x
    return total


def _logs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Logarithms by metric, and which are known if not all."""
    known = ~np.isnan(x.T)
    return np.log(np.where(known, x.T, 1.0)), None if known.all() else known


def _areas(x: np.ndarray, y: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """The exact area under the curve of each candidate (coefs, exponents) over scaled scores x and classes y.

    The classes are sorted apart; each of the fewer rows is sought among the others, of which equal ones count half.
    """
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    x = x[np.argsort(y, kind="stable")]  # negatives first
    logs, known = _logs(x)
    out = np.zeros(len(tried))
    for k, (coef, power) in enumerate(tried):
        s = _scores(logs, known, coef, power)
        few, many = np.sort(s[neg:]), np.sort(s[:neg])
        if pos > neg:
            few, many = many, few
        below = int(np.searchsorted(many, few, "left").sum() + np.searchsorted(many, few, "right").sum())
        out[k] = (below if pos <= neg else 2 * pos * neg - below) / 2 / max(pos * neg, 1)
    return out


def random_search(scores: DataFrame, trials: int = 100_000, batch: int = 2_000, seed: int = 1, swapped: bool = False, exact: int = EXACT) -> list[tuple[str, float, float, float, float]]:
    """Parameters (metric, coef, exponent, min, range) of the best area found.

    Coefficients come from [-1, 1] and exponents from [-1, 3]; after an improvement only the neighbourhood of the best
    is searched, which shrinks with each batch that finds nothing. Scores of one query lie in one row; a metric that
    it lacks adds nothing. Up to ``exact`` rows are broadcast, candidates are spread over the tasks, and their
    areas are exact. With more rows, rows are spread, and each partition counts the positives and
    negatives of a batch of candidates in ``BINS`` bins; only these counts reach the driver.
    """
    limits = {m: (lo, r) for m, lo, r in ranges(scores).orderBy("metric").collect()}
    names = sorted(limits)
    if not names:
        raise ValueError("no scores")
    spark = scores.sparkSession
    share = lambda m: F.lit(0.0) if not limits[m][1] else (F.col(m) - limits[m][0]) / limits[m][1]
    wide = scores.groupBy("name", "positive").pivot("metric", names).agg(F.first("score"))
    wide = wide.select(F.col("positive").cast("double").alias("y"), *(share(m).alias(f"x{k}") for k, m in enumerate(names))).cache()
    rng, n = np.random.default_rng(seed), len(names)

    def sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(pdf[[f"x{k}" for k in range(n)]].to_numpy(), 1e-9), pdf["y"].to_numpy().astype(int)

    small = spark.sparkContext.broadcast(sides(wide.toPandas())) if wide.count() <= exact else None
    centre, idle, best, result = None, 0, -1.0, np.zeros((2, n))
    for _ in range(max(1, trials // batch)):
        low, high = np.array([[-1.0] * n, [-1.0] * n]), np.array([[1.0] * n, [3.0] * n])
        if centre is not None:
            reach = 1 / max(1, idle)
            low, high = np.maximum(low, centre - reach), np.minimum(high, centre + reach)
        tried = rng.uniform(low, high, (batch, 2, n))
        area = _exact_areas(spark, small, tried) if small is not None else _binned_areas(wide, sides, tried)
        area = 1 - area if swapped else area
        if area[k := int(area.argmax())] > best:
            best, centre, idle, result = float(area[k]), tried[k], 0, tried[k]
        else:
            idle += 1
    wide.unpersist()
    return [(m, float(result[0][k]), float(result[1][k]), float(limits[m][0]), float(limits[m][1])) for k, m in enumerate(names)]


def _exact_areas(spark, small, tried: np.ndarray) -> np.ndarray:
    parts = max(1, min(len(tried), spark.sparkContext.defaultParallelism))

    def judge(batches):
        for pdf in batches:
            for k in pdf["id"]:
                at = np.arange(k, len(tried), parts)
                yield pd.DataFrame({"k": at, "area": _areas(*small.value, tried[at])})

    out = np.zeros(len(tried))
    for k, area in spark.range(0, parts, 1, parts).mapInPandas(judge, "k long, area double").collect():
        out[k] = area
    return out


def _binned_areas(wide: DataFrame, sides, tried: np.ndarray) -> np.ndarray:
    """Areas from counts in bins. A partition's counts of a candidate are one row, and the driver gets the areas only."""
    parts = max(1, wide.sparkSession.sparkContext.defaultParallelism)

    def count(batches):
        total = np.zeros((len(tried), 2 * BINS), np.int32)
        for pdf in batches:
            x, y = sides(pdf)
            logs, known = _logs(x)
            for k, (coef, power) in enumerate(tried):
                s = _scores(logs, known, coef, power)
                at = ((np.arctan(s) / np.pi + 0.5) * (BINS - 1)).astype(int)
                total[k] += np.bincount(at * 2 + y, minlength=2 * BINS).astype(np.int32)
        for s in range(0, len(tried), 100):
            yield pd.DataFrame({"k": np.arange(s, min(s + 100, len(tried))), "hits": [h.tobytes() for h in total[s : s + 100]]})

    def judge(batches):
        total = {}
        for pdf in batches:
            for k, hits in zip(pdf["k"], pdf["hits"]):
                total[k] = total.get(k, 0) + np.frombuffer(hits, np.int32).astype(np.int64)
        for k, hits in total.items():
            neg, pos = (hits.reshape(BINS, 2)[::-1, c].astype(float) for c in (0, 1))
            tpr, all_pos = np.cumsum(pos), max(pos.sum(), 1)
            yield pd.DataFrame({"k": [k], "area": [(neg * (tpr - pos / 2)).sum() / all_pos / max(neg.sum(), 1)]})

    out = np.zeros(len(tried))
    for k, area in wide.coalesce(parts).mapInPandas(count, "k long, hits binary").repartition(parts, "k").mapInPandas(judge, "k long, area double").collect():
        out[k] = area
    return out
