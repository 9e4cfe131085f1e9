"""Thresholds against labels, agreement of raters, grades and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranges import running


def threshold_sweep(rows: DataFrame, score: str, label: str, grid: list[float], empty_precision: float = 0.0) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy and rates at every threshold, from one pass."""
    y, s = F.col(label) == 1, F.col(score)
    counts = rows.where(F.col(label).isNotNull() & s.isNotNull()).agg(
        F.count_if(y).alias("p"), F.count("*").alias("n"),
        *[F.count_if(y & (s >= t)).alias(f"tp{i}") for i, t in enumerate(grid)], *[F.count_if(~y & (s >= t)).alias(f"fp{i}") for i, t in enumerate(grid)],
    )
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(grid)])
    x = counts.select("p", "n", F.explode(each).alias("x")).select("x.*", (F.col("p") - F.col("x.tp")).alias("fn"), (F.col("n") - F.col("p") - F.col("x.fp")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(empty_precision)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    made = x.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    total = tp + fp + fn + tn
    fpr, fnr = F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0), F.when(tp + fn > 0, fn / (tp + fn)).otherwise(0.0)
    made = made.withColumns({"f1": f1, "accuracy": F.when(total > 0, (tp + tn) / total).otherwise(0.0), "fpr": fpr, "fnr": fnr})
    return made.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "fpr", "fnr")])


def best_threshold(sweep: DataFrame, strategy: str = "f1") -> DataFrame:
    """The threshold of the best f1, precision, recall, youden or balanced value; ties by F1, precision, recall, threshold."""
    value = {"f1": F.col("f1"), "precision": F.col("precision"), "recall": F.col("recall"), "youden": F.col("recall") - F.col("fpr"), "balanced": -F.abs(F.col("precision") - F.col("recall"))}[strategy]
    order = F.struct(F.round(value, 6).alias("v"), F.col("f1"), F.col("precision"), F.col("recall"), F.col("threshold"))
    return sweep.agg(F.max(order).alias("b")).select("b.threshold", "b.f1", "b.precision", "b.recall")


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores; ties count half; null with one class only."""
    by = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    made = running(by, "s", F.col("q"), "below").agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return made.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.round(F.col("u") / (F.col("p").cast("double") * F.col("q")), 6)).alias("auc"))


def cohens_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance; 1 if chance alone agrees fully."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    left, right = cells.groupBy("x").agg(F.sum("c").alias("cx")), cells.groupBy(F.col("y").alias("x")).agg(F.sum("c").alias("cy"))
    chance = left.join(right, "x").agg(F.sum(F.col("cx").cast("double") * F.col("cy")).alias("e"))
    agreed = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("o"))
    po, pe = F.col("o") / F.col("n"), F.coalesce("e", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return agreed.crossJoin(F.broadcast(chance)).select(F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).otherwise(1.0).alias("kappa"))  # one row each


def fleiss_kappa(ratings: DataFrame, item: str, category: str) -> DataFrame:
    """Agreement of many raters; items need two ratings or more and the same number of them."""
    cells = ratings.groupBy(item, category).agg(F.count("*").alias("c"))
    items = cells.groupBy(item).agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("c")).alias("q")).where("r > 1")
    agreed = items.agg(F.avg((F.col("q") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p"))
    shares = cells.groupBy(category).agg(F.sum("c").alias("c"))
    chance = shares.agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("q"), F.sum("c").alias("n")).select((F.col("q") / (F.col("n").cast("double") * F.col("n"))).alias("e"))
    return agreed.crossJoin(F.broadcast(chance)).select(F.when(F.col("e") < 1, F.round((F.col("p") - F.col("e")) / (1 - F.col("e")), 6)).otherwise(1.0).alias("kappa"))  # one row each


def grade(score: Column) -> Column:
    # Lower ends of the grades.
    made = F.lit("F")
    for least, name in ((60, "D"), (70, "C"), (80, "B-"), (83, "B"), (87, "B+"), (90, "A-"), (93, "A"), (97, "A+")):
        made = F.when(score >= least, name).otherwise(made)
    return made


def reviewer_bias(rows: DataFrame, reviewer: str, score: str, baseline: str) -> DataFrame:
    """Mean error, mean absolute error and population variance of errors by reviewer."""
    error = F.col(score) - F.col(baseline)
    return rows.groupBy(reviewer).agg(F.count("*").alias("n"), F.round(F.avg(error), 6).alias("bias"), F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.var_pop(error), 6).alias("variance"))
