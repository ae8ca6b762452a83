"""Multi-label evaluation of predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistola.functions.values import f1, ratio


def without_others(labels: str):
    """The labels but the catch-all."""
    return F.filter(labels, lambda c: F.lower(c) != "others")


def document_metrics(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Append tp, fp, fn, precision, recall, f1_score, exact_match, jaccard_similarity, counts and the three label lists.

    Two empty sets give precision, recall and F1 of 0 but an exact match and a Jaccard of 1.
    """
    none = F.array().cast("array<string>")
    t, p = F.sort_array(F.array_distinct(F.coalesce(truth, none))), F.sort_array(F.array_distinct(F.coalesce(predicted, none)))
    step = df.withColumns({"__t": t, "__p": p}).withColumns({"correct": F.array_intersect("__t", "__p"), "missed": F.array_except("__t", "__p"), "extra": F.array_except("__p", "__t")})
    step = step.withColumns({"tp": F.size("correct").cast("long"), "fp": F.size("extra").cast("long"), "fn": F.size("missed").cast("long")})
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return step.withColumns(
        {
            "precision": F.bround(precision, 4),
            "recall": F.bround(recall, 4),
            "f1_score": F.bround(f1(precision, recall), 4),
            "exact_match": F.when(F.col("fp") + F.col("fn") == 0, 1.0).otherwise(0.0),
            "jaccard_similarity": F.bround(F.when(union == 0, 1.0).otherwise(F.col("tp") / union), 4),
            "ground_truth_count": F.size("__t").cast("long"),
            "predicted_count": F.size("__p").cast("long"),
        }
    ).drop("__t", "__p")


def batch_metrics(measured: DataFrame, *by: str) -> DataFrame:
    """One row (per `by`): sums, micro figures from them, macro figures as means of the rounded rows, rates and the perfect count."""
    sums = measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum("fn").alias("fn"),
        F.bround(F.avg("precision"), 4).alias("macro_precision"),
        F.bround(F.avg("recall"), 4).alias("macro_recall"),
        F.bround(F.avg("f1_score"), 4).alias("macro_f1"),
        F.bround(F.avg("exact_match"), 4).alias("exact_match_rate"),
        F.bround(F.avg("jaccard_similarity"), 4).alias("mean_jaccard"),
        F.count_if(F.col("exact_match") == 1).alias("perfect"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"micro_precision": F.bround(p, 4), "micro_recall": F.bround(r, 4), "micro_f1": F.bround(f1(p, r), 4)})


def category_metrics(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """category, tp, fp, fn, precision, recall, f1_score, appearances, support."""
    none = F.array().cast("array<string>")
    t, p = F.coalesce(truth, none), F.coalesce(predicted, none)
    each = df.select(F.explode(F.array_union(t, p)).alias("category"), t.alias("t"), p.alias("p"))
    in_t, in_p = F.array_contains("t", F.col("category")), F.array_contains("p", F.col("category"))
    out = each.groupBy("category").agg(
        F.count_if(in_t & in_p).alias("tp"), F.count_if(~in_t & in_p).alias("fp"), F.count_if(in_t & ~in_p).alias("fn"), F.count(F.lit(1)).alias("appearances"), F.count_if(in_t).alias("support")
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": F.bround(precision, 4), "recall": F.bround(recall, 4), "f1_score": F.bround(f1(precision, recall), 4)})


def compare_approaches(df: DataFrame, approach: str = "approach") -> DataFrame:
    """metric, best approach (the first by name of equals) and its value over the batch metrics of each approach."""
    each = batch_metrics(document_metrics(df), approach)
    names = ("micro_precision", "micro_recall", "micro_f1", "exact_match_rate", "mean_jaccard")
    long = each.unpivot([approach], list(names), "metric", "value")
    best = long.groupBy("metric").agg(F.max("value").alias("value"))
    return long.join(best, ["metric", "value"]).groupBy("metric", "value").agg(F.min(approach).alias("best_approach"))


def accuracy_metrics(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: tp, fp, fn, tn over all labels that occur, and micro precision, recall, F1, accuracy."""
    each = category_metrics(df, truth, predicted)
    total = df.agg(F.count(F.lit(1)).alias("documents"))
    joined = each.join(F.broadcast(total))  # one row
    tn = F.col("documents") - F.col("tp") - F.col("fp") - F.col("fn")
    sums = joined.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum(tn).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    right = ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return sums.withColumns({"precision": F.bround(p, 4), "recall": F.bround(r, 4), "f1_score": F.bround(f1(p, r), 4), "accuracy": F.bround(right, 4)})


def share(df: DataFrame, column: str) -> DataFrame:
    """column, n, percent of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    each = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return each.join(F.broadcast(total)).select(column, "n", F.bround(100 * F.col("n") / F.col("total"), 2).alias("percent"))


def against_truth(predictions: DataFrame, truth: DataFrame, loose: bool = False) -> DataFrame:
    """file_name, truth, predicted for the files of both sides; loose ignores case and outer space of the names."""
    name = (lambda c: F.lower(F.trim(c))) if loose else (lambda c: F.col(c))
    t = truth.groupBy(name("file_name").alias("file_name")).agg(F.sort_array(F.collect_set("category")).alias("truth"))
    p = predictions.groupBy(name("file_name").alias("file_name")).agg(F.sort_array(F.collect_set("category")).alias("predicted"))
    return t.where(F.size("truth") > 0).join(p, "file_name")


def best_of(results: DataFrame, key: str = "doc_id", label: str = "category") -> DataFrame:
    """key, label, confidence, approach: the most confident approach per label, the first by name of equals."""
    top = F.max(F.struct("confidence", F.lit(0))).alias("m")
    best = results.groupBy(key, label).agg(top)
    return results.join(best, [key, label]).where(F.col("confidence") == F.col("m.confidence")).groupBy(key, label, "confidence").agg(F.min("approach").alias("approach"))


def run_metrics(runs: DataFrame, seconds: str = "seconds", confidence: str = "confidence", issues: str = "n_issues") -> DataFrame:
    """One row: runs, mean, least and most time and confidence, mean issues, share with any in percent."""
    n = F.count(F.lit(1))
    return runs.agg(
        n.alias("runs"), *[f(c).alias(f"{a}_{c}") for c in (seconds, confidence) for a, f in (("avg", F.avg), ("min", F.min), ("max", F.max))],
        F.avg(issues).alias("avg_issues"), (100 * F.count_if(F.col(issues) > 0) / n).alias("with_any_percent"),
    )


def envelope(results: DataFrame, status: str = "status", seconds: str = "seconds") -> DataFrame:
    """One row: total, success, failed, avg_seconds, success_rate and PARTIAL or SUCCESS."""
    n, good = F.count(F.lit(1)), F.count_if(F.col(status) == "success")
    return results.agg(
        n.alias("total"), good.alias("success"), (n - good).alias("failed"), F.avg(seconds).alias("avg_seconds"), F.coalesce(F.try_divide(good, n), F.lit(0.0)).alias("success_rate"),
        F.when(good < n, "PARTIAL").otherwise("SUCCESS").alias("state"),
    )


def health(services: DataFrame) -> DataFrame:
    """One row from services(name, status, available): unhealthy on an error, degraded if one is missing, else healthy."""
    error, all_there = F.bool_or(F.col("status") == "error"), F.bool_and("available")
    return services.agg(F.when(error, "unhealthy").when(all_there, "healthy").otherwise("degraded").alias("health"))


def keyword_baseline(docs: DataFrame, issues: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, issue_type, category for the issues(issue_type, category) of which a word stands in the text: an equi-join on words."""
    from epistola.functions.text import words

    have = docs.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    want = issues.select("issue_type", "category", F.explode(F.array_distinct(words(F.col("issue_type")))).alias("word"))
    return have.join(want, "word").select(key, "issue_type", "category").distinct()


def report_text(row: dict) -> str:
    """The figures of a batch_metrics row as lines."""
    return "\n".join(f"{name.replace('_', ' ')}: {value}" for name, value in row.items())
