"""Accuracy of predictions (tool, dataset, level, taxid, abundance) against truth (dataset, level, taxid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readmill.functions import sequences as S

KEYS = ["tool", "dataset", "level"]


def _once(pred: DataFrame, keys: list[str]) -> DataFrame:
    """pred with one row for each taxon of a key: that of the largest abundance."""
    rest = [c for c in pred.columns if c not in (*keys, "taxid", "abundance")]
    return pred.groupBy(*keys, "taxid").agg(F.max(F.struct("abundance", *rest)).alias("_x")).select(*keys, "taxid", "_x.*")


def prefix_curve(pred: DataFrame, truth: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, taxid, abundance, rank, tp, precision, recall, f1) at every prefix by abundance, ties by taxid.

    A taxon that is predicted more than once counts once, with its largest abundance.
    """
    pred = _once(pred, keys)
    of = [k for k in keys if k in truth.columns]
    t = truth.select(*of, "taxid").distinct()
    size = t.groupBy(*of).agg(F.count(F.lit(1)).alias("n_truth"))
    hit = pred.join(t.withColumn("_hit", F.lit(1)), [*of, "taxid"], "left").join(size, of, "left")
    w = Window.partitionBy(*keys).orderBy(F.desc("abundance"), "taxid")
    hit = hit.withColumn("rank", F.row_number().over(w)).withColumn("tp", F.sum(F.coalesce("_hit", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = hit.withColumns({"precision": F.col("tp") / F.col("rank"), "recall": S.safe_ratio(F.col("tp"), F.coalesce("n_truth", F.lit(0)))})
    return hit.withColumn("f1", S.f1_score(F.col("precision"), F.col("recall"))).drop("_hit")


def best_f1(curve: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Precision, recall, F1, TP, FP and FN at the first prefix of maximal F1."""
    best = F.max_by(F.struct("precision", "recall", "f1", "tp", "rank", "n_truth"), F.struct(F.col("f1"), -F.col("rank")))
    x = curve.groupBy(*keys).agg(best.alias("x"))
    return x.select(*keys, "x.precision", "x.recall", "x.f1", F.col("x.tp").cast("bigint").alias("tp"), (F.col("x.rank") - F.col("x.tp")).cast("bigint").alias("fp"), (F.coalesce("x.n_truth", F.lit(0)) - F.col("x.tp")).cast("bigint").alias("fn"))


def questions(pred: DataFrame, truth: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Distinct keys that are to be answered: those of predictions, and the truth's, which every tool that predicts anything in a dataset answers at all levels."""
    of = [k for k in keys if k in truth.columns]
    asked = truth.select(*of).distinct()
    if extra := [k for k in keys if k not in of]:
        by = [k for k in of if k != "level"]
        asked = pred.select(*extra, *by).distinct().join(asked, by) if by else pred.select(*extra).distinct().join(F.broadcast(asked))
    return pred.select(*keys).distinct().unionByName(asked.select(*keys)).distinct()


def aupr(pred: DataFrame, truth: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Area under the precision-recall curve over predictions and truth together; equal scores are one step, trapezoids from (0, 1). Repeated predictions as in `prefix_curve`."""
    of = [k for k in keys if k in truth.columns]
    t = truth.select(*of, "taxid").distinct().withColumn("_y", F.lit(1))
    if len(of) < len(keys):
        t = questions(pred, truth, keys).join(t, of)
    both = _once(pred.select(*keys, "taxid", "abundance"), keys).join(t, [*keys, "taxid"], "full").select(*keys, F.coalesce("abundance", F.lit(0.0)).alias("s"), F.coalesce("_y", F.lit(0)).alias("y"))
    steps = both.groupBy(*keys, "s").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("s"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"tp": F.sum("y").over(run), "k": F.sum("n").over(run), "all": F.sum("y").over(Window.partitionBy(*keys))})
    steps = steps.withColumns({"p": F.col("tp") / F.col("k"), "r": S.safe_ratio(F.col("tp"), F.col("all"))})
    area = (F.col("r") - F.coalesce(F.lag("r").over(w), F.lit(0.0))) * (F.col("p") + F.coalesce(F.lag("p").over(w), F.lit(1.0))) / 2
    return steps.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias("aupr"))


def metrics(pred: DataFrame, truth: DataFrame, keys: list[str] = KEYS, asked: DataFrame | None = None) -> DataFrame:
    """(keys, precision, recall, f1, tp, fp, fn, aupr) for all `questions` (and those asked); without predictions all rates are 0 and fn is the truth's size."""
    of = [k for k in keys if k in truth.columns]
    size = truth.select(*of, "taxid").distinct().groupBy(*of).agg(F.count(F.lit(1)).alias("_n"))
    keyed = questions(pred, truth, keys)
    keyed = keyed.unionByName(asked.select(*keys)).distinct() if asked is not None else keyed
    found = keyed.join(size, of, "left").join(best_f1(prefix_curve(pred, truth, keys), keys), keys, "left").join(aupr(pred, truth, keys), keys, "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("precision", "recall", "f1")} | {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("tp", "fp")} | {"fn": F.coalesce("fn", "_n", F.lit(0).cast("bigint"))}
    # a curve over truth alone has one step of score 0 whose area is not a tool's: nothing was predicted
    return found.withColumns({"aupr": F.when(F.col("precision").isNull(), 0.0).otherwise(F.coalesce("aupr", F.lit(0.0)))} | zero).drop("_n")


def confusion(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """TP, FP and FN of whole sets by a full join."""
    p, t = pred.select(*keys, "taxid").distinct().withColumn("_p", F.lit(1)), truth.select(*keys, "taxid").distinct().withColumn("_t", F.lit(1))
    both = p.join(t, [*keys, "taxid"], "full")
    return both.groupBy(*keys).agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))


def scoring_total(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Total reads for scoring: the genus sum, else the species sum, else a million."""
    part = lambda level: F.sum(F.when(F.col("level") == level, F.col("abundance")))
    return pred.groupBy(*keys).agg(F.coalesce(F.nullif(part("genus"), F.lit(0.0)), F.nullif(part("species"), F.lit(0.0)), F.lit(1e6)).alias("total_reads"))


def report_total(report: DataFrame, keys: list[str]) -> DataFrame:
    """The root's reads, else the sum over all rows."""
    return report.groupBy(*keys).agg(F.coalesce(F.nullif(F.max(F.when(F.col("taxid") == 1, F.col("reads"))), F.lit(0)), F.sum("reads")).alias("total_reads"))


def complete_tools(results: DataFrame, n_datasets: int, tool: str = "tool", dataset: str = "dataset") -> DataFrame:
    """Tools with results for every dataset."""
    return results.groupBy(tool).agg(F.count_distinct(dataset).alias("n_datasets")).where(F.col("n_datasets") == n_datasets)


def summary(results: DataFrame, values: list[str], tool: str = "tool") -> DataFrame:
    """Mean and population deviation of each value for each tool."""
    return results.groupBy(tool).agg(F.count(F.lit(1)).alias("n_datasets"), *(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def param_set_in(tool: Column, preprocessing: DataFrame) -> Column:
    """The longest parameter set of preprocessing (dataset, param_set, ...) that the tool's name holds, but for a mark of quick runs; null if none."""
    names = [r.param_set for r in preprocessing.select("param_set").distinct().collect()]  # as many as a sweep has
    found = [(n, F.replace(tool, F.lit("_quick"), F.lit("")).contains(n)) for n in sorted(names, key=lambda n: (-len(n), n))]
    return F.coalesce(F.lit(None).cast("string"), *(F.when(c, F.lit(n)) for n, c in found))


def with_runtimes(results: DataFrame, runtimes: DataFrame, normalizer: DataFrame | None = None) -> DataFrame:
    """results with `runtime_s`, and the normalizer's `preprocess_s` for (dataset, param_set), 0 where there is none."""
    out = results.join(runtimes.select("tool", "dataset", "runtime_s") if "tool" in runtimes.columns else runtimes.select("dataset", "runtime_s"), [c for c in ("tool", "dataset") if c in runtimes.columns], "left")
    if normalizer is None:
        return out.withColumn("preprocess_s", F.lit(0.0))
    before = normalizer.select("dataset", "param_set", F.col("runtime_s").cast("double").alias("preprocess_s"))
    return out.join(before, ["dataset", "param_set"], "left").withColumn("preprocess_s", F.coalesce("preprocess_s", F.lit(0.0)))


def metric_plot(results: DataFrame, values: tuple[str, ...] = ("f1", "recall")) -> DataFrame:
    """Rows of the grouped bars of a plot: (tool, level, value, mean, std) of metrics (tool, dataset, level, ...)."""
    long = results.select("tool", "level", F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).alias("x")) for v in values))).alias("v"))
    return long.groupBy("tool", "level", F.col("v.value").alias("value")).agg(F.avg("v.x").alias("mean"), F.stddev_pop("v.x").alias("std"))


def runtime_plot(results: DataFrame) -> DataFrame:
    """Rows of the stacked runtime plot: means for each tool with labels, and the scale."""
    x = results.where(F.col("runtime_s").isNotNull()).groupBy("tool").agg(F.avg("runtime_s").alias("classify_s"), F.avg("preprocess_s").alias("preprocess_s"))
    x = x.withColumn("total_s", F.col("classify_s") + F.col("preprocess_s"))
    return x.withColumn("label", S.duration_label(F.col("total_s"))).withColumn("scale_s", F.max("total_s").over(Window.partitionBy()))
