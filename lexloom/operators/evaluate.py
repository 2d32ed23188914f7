"""Evaluation of scored rows: `actual` (0 or 1) and `predicted` (a probability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import split

EPSILON = 1e-15


def log_loss(scored: DataFrame) -> DataFrame:
    """log_loss: mean negative log-likelihood, probabilities clipped."""
    p = F.least(F.greatest(F.col("predicted"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    y = F.col("actual")
    return scored.agg((-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def over(threshold: float, inclusive: bool = False) -> Column:
    """Whether a score passes: above the threshold in evaluation, at or above it in deployment. Not a number never passes."""
    p = F.col("predicted")
    return ~F.isnan(p) & (p >= threshold if inclusive else p > threshold)


def _cells(passed: Column) -> list[Column]:
    y = F.col("actual") == 1
    return [F.count_if(~passed & ~y).alias("tn"), F.count_if(passed & ~y).alias("fp"), F.count_if(~passed & y).alias("fn"), F.count_if(passed & y).alias("tp")]


def confusion_sweep(scored: DataFrame, start: int = 10, stop: int = 90, step: int = 5) -> DataFrame:
    """threshold, tn, fp, fn, tp for thresholds in hundredths from start up to before stop.

    Scores are first summed by how many thresholds they pass: one pass over the rows, then a few rows to sum again.
    """
    marks = range(start, stop, step)
    passed = sum((over(m / 100.0).cast("int") for m in marks), F.lit(0))
    sums = scored.groupBy(passed.alias("passed"), (F.col("actual") == 1).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m / 100.0).alias("threshold")) for i, m in enumerate(marks)]))
    each = sums.withColumn("m", rows).select("m.threshold", "y", "n", (F.col("passed") > F.col("m.i")).alias("over"))
    cell = lambda y, o: F.sum(F.when((F.col("y") == y) & (F.col("over") == o), F.col("n")).otherwise(0))
    return each.groupBy("threshold").agg(cell(False, False).alias("tn"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(True, True).alias("tp"))


def precision_recall(scored: DataFrame, threshold: float) -> DataFrame:
    """precision, recall at a threshold; 0 where undefined."""
    c = scored.agg(*_cells(over(threshold)))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return c.select(ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def with_buckets(scored: DataFrame, threshold: float) -> DataFrame:
    """scored with threshold_pred and bucket (TP, FP, FN, TN)."""
    y = F.col("actual") == 1
    passed = over(threshold)
    name = F.when(passed & y, "TP").when(passed, "FP").when(y, "FN").otherwise("TN")
    return scored.withColumn("threshold_pred", passed).withColumn("bucket", name)


def bucket_report(scored: DataFrame, threshold: float, bucket: str) -> DataFrame:
    """title, predicted, actual, threshold_pred of one bucket."""
    return with_buckets(scored, threshold).where(F.col("bucket") == bucket).select("title", "predicted", "actual", "threshold_pred")


def _ranked(scored: DataFrame) -> DataFrame:
    """threshold, tp, fp, tpr, fpr, pos (positives of that score), n at each distinct score.

    Rows are summed by score first; scores are cut into ranges whose sums are added up in order, so that no task runs
    over all scores.
    """
    by = scored.groupBy("predicted").agg(F.sum("actual").alias("pos"), F.count(F.lit(1)).alias("n"))
    ranged = stored(by.repartitionByRange(F.desc("predicted")).withColumn("r", F.spark_partition_id()), "roc-ranges")
    sums = ranged.groupBy("r").agg(F.sum("pos").alias("r_pos"), F.sum("n").alias("r_n"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = sums.select("r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in ("r_pos", "r_n")], *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("r_pos", "r_n")])
    own = Window.partitionBy("r").orderBy(F.desc("predicted"))
    run = ranged.withColumn("tp", F.sum("pos").over(own)).withColumn("k", F.sum("n").over(own)).join(F.broadcast(ranges), "r")
    tp = F.col("tp") + F.col("b_r_pos")
    fp = F.col("k") + F.col("b_r_n") - tp
    return run.select(F.col("predicted").alias("threshold"), tp.cast("double").alias("tp"), fp.cast("double").alias("fp"), (tp / F.col("all_r_pos")).alias("tpr"), (fp / (F.col("all_r_n") - F.col("all_r_pos"))).alias("fpr"), F.col("pos").cast("double").alias("pos"), "n")


def roc_points(scored: DataFrame) -> DataFrame:
    """threshold, tp, fp, tpr, fpr at each distinct score, and the point (0, 0)."""
    points = _ranked(scored).drop("pos", "n")
    first = scored.sparkSession.createDataFrame([(None, 0.0, 0.0, 0.0, 0.0)], points.schema)
    return points.unionByName(first)


def roc_auc(scored: DataFrame) -> DataFrame:
    """auc by the trapezoid rule, from rank sums: pairs of a positive over a negative, ties by half."""
    points = _ranked(scored).where(F.col("threshold").isNotNull())
    neg = F.col("n") - F.col("pos")
    won = F.sum(neg * (F.col("tp") - F.col("pos") / 2))
    return points.agg((won / (F.sum("pos") * F.sum(neg))).alias("auc"))


def roc_grid(scored: DataFrame, n: int = 100) -> DataFrame:
    """fpr, tpr at n even steps of fpr, interpolated between the ROC's points; the first is (0, 0).

    Each segment between neighbouring points gives the steps that lie in it; of several points with one fpr the last
    counts at it.
    """
    points = roc_points(scored).groupBy("fpr").agg(F.min("tpr").alias("low"), F.max("tpr").alias("high"))
    ranged = stored(points.repartitionByRange(F.col("fpr")).withColumn("r", F.spark_partition_id()), "roc-grid-ranges")
    # The next point of a range's last row is the first of the next range that has rows.
    firsts = ranged.groupBy("r").agg(F.min(F.struct("fpr", "low")).alias("first"))
    nexts = firsts.select("r", F.lead("first").over(Window.orderBy("r")).alias("next_first"))
    own = Window.partitionBy("r").orderBy("fpr")
    seg = ranged.withColumn("nxt", F.lead(F.struct("fpr", "low")).over(own)).join(F.broadcast(nexts), "r").withColumn("nxt", F.coalesce("nxt", "next_first"))
    step = F.lit(float(n - 1))
    lo, hi = F.ceil(F.col("fpr") * step - 1e-9), F.coalesce(F.ceil(F.col("nxt.fpr") * step - 1e-9) - 1, F.lit(n - 1))
    each = seg.where(hi >= lo).withColumn("i", F.explode(F.sequence(lo, hi)))
    x = F.col("i") / step
    slope = F.coalesce((F.col("nxt.low") - F.col("high")) / (F.col("nxt.fpr") - F.col("fpr")), F.lit(0.0))
    return each.select(x.alias("fpr"), F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.col("high") + slope * (x - F.col("fpr"))).alias("tpr"))


def best_parameter(scores: DataFrame, parameter: str = "c", score: str = "score") -> DataFrame:
    """The parameter of least score (ties: the least parameter), with the score."""
    return scores.agg(F.min(F.struct(score, parameter)).alias("x")).select(F.col(f"x.{parameter}").alias(parameter), F.col(f"x.{score}").alias(score))


def bucket_ends(scored: DataFrame, threshold: float, bucket: str, n: int = 20, last: bool = False) -> DataFrame:
    """The n rows of a bucket with the least scores, or with the largest (ties by title, in either case)."""
    rows = bucket_report(scored, threshold, bucket)
    return rows.orderBy(F.desc("predicted") if last else "predicted", F.desc("title") if last else "title").limit(n)


def importance_slices(ranked: DataFrame, value: str = "coef", key: str = "term", ends: int = 5, middle: int = 10) -> DataFrame:
    """part (bottom, middle, top), rank and the rows of least, middle and largest value. Ranks come from ranges of rows, not from one task."""
    numbered = split.placed(ranked, value, key)
    rank, n = F.col("_place"), F.col("_all")
    half = F.floor(n / 2)
    part = F.when(rank < ends, "bottom").when(rank >= n - ends, "top").when((rank >= half - middle // 2) & (rank < half + middle // 2), "middle")
    return numbered.withColumn("rank", rank.cast("int")).withColumn("part", part).where(F.col("part").isNotNull()).drop("_place", "_all")


def extrapolated(counted: int, of: int, population: float) -> float:
    """A count as a share of what it was counted in, times a population."""
    return counted / of * population
