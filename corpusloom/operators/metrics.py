"""Analytics of training and evaluation: weighted losses, perplexity, curves by step, candidate selection.

Curves are rows (run, step, loss, ...); every window is partitioned by run, so runs are computed side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_loss(blocks: DataFrame, by: list[str], loss: str = "loss", tokens: str = "tokens", first: int | None = None, position: str = "block") -> DataFrame:
    """by, loss: the mean weighted by tokens, of the first blocks if so asked."""
    rows = blocks if first is None else blocks.where(F.col(position) < first)
    return rows.groupBy(*by).agg((F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)).alias("loss"))


def perplexity(blocks: DataFrame, by: list[str], nll: str = "nll", length: str = "length") -> DataFrame:
    """by, perplexity: exp of the summed negative log likelihood per scored token; a block's first token is not scored."""
    return blocks.groupBy(*by).agg(F.exp(F.sum(nll) / F.sum(F.col(length) - 1)).alias("perplexity"))


def compare_models(scores: DataFrame, base: str = "base", new: str = "cpt") -> DataFrame:
    """set, base, new, reduction_percent (two places), in_band (10 to 40) from rows (set, model, perplexity)."""
    wide = scores.groupBy("set").pivot("model", [base, new]).agg(F.first("perplexity"))
    drop = 100 * (1 - F.col(new) / F.col(base))
    return wide.select("set", F.col(base).alias("base"), F.col(new).alias("new"), F.round(drop, 2).alias("reduction_percent"), drop.between(10, 40).alias("in_band"))


def rolling_mean(curve: DataFrame, window: int = 5, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """curve with smooth: the mean of this and the rows before it, `window` at most."""
    return curve.withColumn("smooth", F.avg(loss).over(W.partitionBy(run).orderBy(step).rowsBetween(1 - window, 0)))


def plateau(curve: DataFrame, window: int = 5, tolerance: float = 0.02, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """run, step of the first row from `window` on where the smoothed loss falls by less than the tolerance in the next `window` rows."""
    w = W.partitionBy(run).orderBy(step)
    rows = rolling_mean(curve.where(F.col(loss).isNotNull()), window, run, step, loss).withColumns({"i": F.row_number().over(w) - 1, "ahead": F.lead("smooth", window).over(w)})
    flat = (F.col("i") >= window) & F.col("ahead").isNotNull() & ((F.col("smooth") - F.col("ahead")) / F.col("smooth") < tolerance)
    return rows.groupBy(run).agg(F.min(F.when(flat, F.col(step))).alias("plateau_step"))


def adaptive_window(curve: DataFrame, run: str = "run", loss: str = "loss") -> DataFrame:
    """run, window: the larger of 3 and a tenth of the rows that have a loss."""
    return curve.groupBy(run).agg(F.greatest(F.lit(3), F.floor(F.count(loss) / 10).cast("int")).alias("window"))


def heldout_plateau(curve: DataFrame, tolerance: float = 0.01, run: str = "run", step: str = "step", loss: str = "eval_loss") -> DataFrame:
    """run, step of the first evaluation, not the last, after which the loss never falls by the tolerance."""
    w = W.partitionBy(run).orderBy(step)
    rows = curve.where(F.col(loss).isNotNull()).withColumn("least", F.min(loss).over(w.rowsBetween(1, W.unboundedFollowing)))
    flat = F.col("least").isNotNull() & ((F.col(loss) - F.col("least")) / F.col(loss) < tolerance)
    return rows.groupBy(run).agg(F.min(F.when(flat, F.col(step))).alias("heldout_plateau_step"))


def curve_summary(curve: DataFrame, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """run, n, first_loss, last_loss, min_loss, min_step (first of equals), drop_percent, last_nonzero; rows without a loss are left out."""
    rows = curve.where(F.col(loss).isNotNull())
    best = F.min(F.struct(F.col(loss).alias("l"), F.col(step).alias("s")))
    first, last = F.min_by(loss, step), F.max_by(loss, step)
    return rows.groupBy(run).agg(
        F.count("*").alias("n"), first.alias("first_loss"), last.alias("last_loss"), best["l"].alias("min_loss"), best["s"].alias("min_step"),
        F.round(100 * (1 - last / first), 2).alias("drop_percent"), F.max_by(F.when(F.col(loss) != 0, F.col(loss)), F.when(F.col(loss) != 0, F.col(step))).alias("last_nonzero"),
    )


def head_tail_means(curve: DataFrame, window: int, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """run, head_mean, tail_mean of the first and last `window` losses."""
    w = W.partitionBy(run)
    rows = curve.where(F.col(loss).isNotNull()).withColumns({"i": F.row_number().over(w.orderBy(step)), "j": F.row_number().over(w.orderBy(F.desc(step)))})
    return rows.groupBy(run).agg(F.avg(F.when(F.col("i") <= window, F.col(loss))).alias("head_mean"), F.avg(F.when(F.col("j") <= window, F.col(loss))).alias("tail_mean"))


def loss_summary(curve: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """One row for each run of a log (run, step, loss, eval_loss): endpoints, least losses, drops of the endpoints and of the means
    of the first and last `window` rows (the adaptive window), plateaus, the final gap between training and evaluation."""
    train = curve.where(F.col("loss").isNotNull())
    by = W.partitionBy(run)
    rows = train.join(adaptive_window(train, run), run).withColumns({"i": F.row_number().over(by.orderBy(step)), "j": F.row_number().over(by.orderBy(F.desc(step)))})
    head, tail = (F.avg(F.when(F.col(k) <= F.col("window"), F.col("loss"))) for k in ("i", "j"))
    means = rows.groupBy(run).agg(F.first("window").alias("window"), head.alias("head_mean"), tail.alias("tail_mean"))
    evals = curve_summary(curve, run, step, "eval_loss").select(run, F.col("first_loss").alias("first_eval_loss"), F.col("last_loss").alias("last_eval_loss"), F.col("min_loss").alias("min_eval_loss"), F.col("min_step").alias("min_eval_loss_step"))
    both = curve_summary(train, run, step).join(means, run).join(plateau(curve, run=run, step=step), run, "left").join(heldout_plateau(curve, run=run, step=step), run, "left").join(evals, run, "left")
    return both.select(
        run, F.col("first_loss").alias("first_logged_loss"), F.col("last_loss").alias("last_logged_loss"), "min_loss", F.col("drop_percent").alias("endpoint_loss_drop_percent"),
        F.round(100 * (1 - F.col("tail_mean") / F.col("head_mean")), 2).alias("window_mean_loss_drop_percent"), "window", "plateau_step", F.col("heldout_plateau_step").alias("eval_plateau_step"),
        F.round(F.col("tail_mean") - F.col("last_eval_loss"), 4).alias("final_train_eval_gap"), "first_eval_loss", "last_eval_loss", "min_eval_loss", "min_eval_loss_step",
    )


def perplexity_report(scores: DataFrame, optional: str = "eval_unseen") -> DataFrame:
    """One row from rows (set, model, perplexity, tokens): tokens, base_ppl, cpt_ppl, ppl_reduction_percent of the held-out set
    `eval`; the same as unseen_ columns of the optional set, null where it is not there; within_expected_10_40_percent."""
    pick = lambda c, which, model=None: F.max(F.when((F.col("set") == which) & (F.lit(True) if model is None else F.col("model") == model), F.col(c)))
    out = []
    for which, prefix in (("eval", ""), (optional, "unseen_")):
        base, new = pick("perplexity", which, "base"), pick("perplexity", which, "cpt")
        out += [pick("tokens", which).alias(f"{prefix}eval_tokens"), F.round(base, 4).alias(f"{prefix}base_ppl"), F.round(new, 4).alias(f"{prefix}cpt_ppl"), F.round(100 * (base - new) / base, 2).alias(f"{prefix}ppl_reduction_percent")]
    return scores.agg(*out).withColumn("within_expected_10_40_percent", F.col("ppl_reduction_percent").between(10, 40))


def epoch_means(curve: DataFrame, at: int, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """run, first_mean (steps up to `at`), second_mean (later ones)."""
    return curve.groupBy(run).agg(F.avg(F.when(F.col(step) <= at, F.col(loss))).alias("first_mean"), F.avg(F.when(F.col(step) > at, F.col(loss))).alias("second_mean"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin (from 0), n: equal widths from the least value to the largest, which falls into the last bin."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    return df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def select_candidate(sweep: DataFrame, facts: str = "general_facts_kept", ppl: str = "heldout_ppl") -> DataFrame:
    """The row that keeps most facts (`k/3` counts k), then has the lowest perplexity, then the first name."""
    return sweep.withColumn("_k", F.split(facts, "/")[0].cast("int")).orderBy(F.desc("_k"), ppl, "candidate").limit(1).drop("_k")


def candidate_by_name(sweep: DataFrame, name: str | Column) -> DataFrame:
    """The rows of one candidate; none if there is no such name."""
    return sweep.where(F.col("candidate") == name)


def training_steps(examples: Column, batch: int, epochs: int) -> Column:
    """Updates of a run: batches of an epoch, rounded up, times epochs."""
    return (F.ceil(examples / batch) * epochs).cast("long")


def non_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def transpose_map(df: DataFrame, column: str, key: str = "name") -> DataFrame:
    """A map of structs as one row for each key, the struct's fields as columns."""
    return df.select(F.explode(column).alias(key, "_v")).select(key, "_v.*")
