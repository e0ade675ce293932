"""Evaluation of binary predictions and tests of differences between models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbayes.storage import in_order

#: The compared pairs of models.
MCNEMAR_PAIRS = [("StandardNB", "SDFWNB"), ("FWNB", "DFWNB-v2"), ("DFWNB-v2", "SDFWNB")]
BOOTSTRAP_PAIRS = [("StandardNB", "FWNB"), ("FWNB", "DFWNB-v2"), ("DFWNB-v2", "SDFWNB"), ("StandardNB", "SDFWNB")]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(predicted: DataFrame) -> DataFrame:
    """(model, tn, fp, fn, tp)."""
    y, p = F.col("label") == 1, F.col("pred") == 1
    return predicted.groupBy("model").agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp")
    )


def auc(predicted: DataFrame, score: str = "p1") -> DataFrame:
    """(model, auc) by the sum of average ranks; null for a model with one class only.

    Equal scores are counted first; distinct scores are then dealt by ranges, and only the sums of ranges are added up in one place.
    """
    ties = predicted.groupBy("model", F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("ones"))
    ordered = in_order(ties, [F.col("model"), F.col("s")], "ranks", F.col("n"))
    # ranks start anew with each model: the least number before any of its scores is where it starts
    got = ordered.groupBy("model").agg(
        F.min("before").alias("start"), F.sum((F.col("before") + (F.col("n") + 1) / 2.0) * F.col("ones")).alias("r"), F.sum("ones").alias("n1"),
        (F.sum("n") - F.sum("ones")).alias("n0")
    )
    rank_sum = F.col("r") - F.col("start").cast("double") * F.col("n1")
    value = (rank_sum - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1").cast("double") * F.col("n0"))
    return got.select("model", F.when((F.col("n1") > 0) & (F.col("n0") > 0), value).alias("auc"))


def metrics(predicted: DataFrame) -> DataFrame:
    """One row for each model with accuracy, precision, recall and F1 of each class, their means, balanced accuracy, specificity and AUC."""
    c = confusion(predicted)
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    c = c.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision_negative": ratio(tn, tn + fn), "recall_negative": ratio(tn, tn + fp), "precision_positive": ratio(tp, tp + fp), "recall_positive": ratio(tp, tp + fn)})
    f1 = lambda k: ratio(2 * F.col(f"precision_{k}") * F.col(f"recall_{k}"), F.col(f"precision_{k}") + F.col(f"recall_{k}"))
    c = c.withColumns({f"f1_{k}": f1(k) for k in ("negative", "positive")})
    c = c.withColumns({f"macro_{m}": (F.col(f"{m}_negative") + F.col(f"{m}_positive")) / 2 for m in ("precision", "recall", "f1")})
    c = c.withColumns({"balanced_accuracy": F.col("macro_recall"), "specificity": F.col("recall_negative")})
    return c.join(auc(predicted), "model", "left")


def binomial_lower_tail(k: Column, n: Column) -> Column:
    """P[Binomial(n, 1/2) <= k], by logarithms, so that no n makes it 0; the terms' ratios are summed from the largest."""
    # with the last term as unit, the sum is 1 + k/(n-k+1) * (1 + (k-1)/(n-k+2) * (...)); the last term's logarithm is a sum of ln
    inner = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(1.0), lambda acc, i: 1 + acc * i / (n - i + 1))
    log_choose = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.ln((n - i + 1) / i))
    tail = F.exp(log_choose + F.ln(inner) - n * F.ln(F.lit(2.0)))
    return F.when(k >= n, F.lit(1.0)).when(k <= 0, F.exp(-n * F.ln(F.lit(2.0)))).otherwise(F.least(tail, F.lit(1.0)))


def paired(predicted: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(model_a, model_b, doc_id, label, pred_a, pred_b) of the given pairs, by pivoting each document's predictions once."""
    names = sorted({m for p in pairs for m in p})
    wide = predicted.groupBy("doc_id").agg(F.first("label").alias("label"), *(F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in names))
    each = F.array(*(
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}`").alias("pred_a"), F.col(f"`{b}`").alias("pred_b")) for a,
        b in pairs
    ))
    return wide.select("doc_id", "label", F.explode(each).alias("p")).select("p.model_a", "p.model_b", "doc_id", "label", "p.pred_a", "p.pred_b")


def mcnemar(predicted: DataFrame, pairs: list[tuple[str, str]] = MCNEMAR_PAIRS) -> DataFrame:
    """Exact two-sided McNemar tests: min(1, 2 P[Binomial(b + c, 1/2) <= min(b, c)]), 1 without discordant documents."""
    ok_a, ok_b = F.col("pred_a") == F.col("label"), F.col("pred_b") == F.col("label")
    t = paired(predicted, pairs).groupBy("model_a", "model_b").agg(
        F.count_if(ok_a & ~ok_b).alias("a_correct_b_wrong"), F.count_if(~ok_a & ok_b).alias("a_wrong_b_correct")
    )
    b, c = F.col("a_correct_b_wrong"), F.col("a_wrong_b_correct")
    t = t.withColumn("discordant_pairs", b + c)
    p = F.when(F.col("discordant_pairs") == 0, F.lit(1.0)).otherwise(F.least(2 * binomial_lower_tail(F.least(b, c), F.col("discordant_pairs")), F.lit(1.0)))
    t = t.withColumn("p_value_exact_two_sided", p)
    return t.withColumn("significant_at_0.05", F.col("p_value_exact_two_sided") < 0.05)


def cells(predicted: DataFrame, pairs: list[tuple[str, str]] = BOOTSTRAP_PAIRS) -> DataFrame:
    """(model_a, model_b, label, pred_a, pred_b, n): documents by label and the predictions of two models, eight cells at most."""
    return paired(predicted, pairs).groupBy("model_a", "model_b", "label", "pred_a", "pred_b").agg(F.count("*").alias("n"))


def macro_f1(n: np.ndarray, label: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Macro F1 of each row of counts of cells; a class that is neither there nor predicted has 0."""
    n, out = n.astype(np.int64), 0.0
    for c in (0, 1):
        hit, both = n[:, (label == c) & (pred == c)].sum(1), n[:, label == c].sum(1) + n[:, pred == c].sum(1)
        out = out + np.where(both > 0, 2 * hit / np.maximum(both, 1), 0.0)
    return out / 2


def bootstrap(predicted: DataFrame, resamples: int = 5000, seed: int = 142, pairs: list[tuple[str, str]] = BOOTSTRAP_PAIRS) -> DataFrame:
    """Percentile intervals of differences in macro F1 between models, by paired resampling of documents.

    Macro F1 is a function of the cells, and resampled documents fall into the cells like a multinomial draw, so a resample is a draw of
    eight numbers, however many documents there are. Each pair draws from the same seed, so results repeat.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "pred_a", "pred_b"])
        label, a, b, n = (pdf[c].to_numpy(np.int64) for c in ("label", "pred_a", "pred_b", "n"))
        drawn = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), resamples)
        diffs = macro_f1(drawn, label, b) - macro_f1(drawn, label, a)
        low, high = np.percentile(diffs, [2.5, 97.5])
        return pd.DataFrame([[pdf.model_a.iloc[0], pdf.model_b.iloc[0], diffs.mean(), low, high, bool(low > 0 or high < 0), resamples, seed]], columns=names)

    names = ["model_old", "model_new", "mean_macro_f1_difference", "ci_95_lower", "ci_95_upper", "ci_excludes_zero", "bootstrap_resamples", "random_seed"]
    kinds = "model_old string, model_new string, mean_macro_f1_difference double, ci_95_lower double, ci_95_upper double, ci_excludes_zero boolean, bootstrap_resamples int, random_seed int"
    return cells(predicted, pairs).groupBy("model_a", "model_b").applyInPandas(run, kinds)


def macro_f1_only(predicted: DataFrame) -> DataFrame:
    """(model, macro_f1)."""
    return metrics(predicted).select("model", "macro_f1")
