"""Analysis of training and hardware logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Losses this near are a tie; throughput to beat, and by how much.
TIE, BASE_RATE, GAIN = 0.02, 19_060.0, 0.10
#: Fixed values of the choice between tokenizers.
BETTER, GENERAL_LEAST = 1.02, 0.92


def weighted_loss(losses: DataFrame, domain: str = "domain", loss: str = "loss", weight: str = "weight", stem: tuple[str, ...] = ("math", "code", "science")) -> DataFrame:
    """overall and stem: means of the domains' losses by weight, over the domains that are there."""
    mean = lambda hit: F.round(F.sum(F.when(hit, F.col(weight) * F.col(loss))) / F.sum(F.when(hit, F.col(weight))), 9)
    return losses.agg(mean(F.lit(True)).alias("overall"), mean(F.col(domain).isin(*stem)).alias("stem"))


def nearest(points: DataFrame, marks: list[int], x: str, y: str, series: str, order: str) -> DataFrame:
    """series, mark, x, y of the point nearest to each mark, the first of equals.

    The marks are a few constants: each row carries them and one aggregate picks the nearest, map-side.
    """
    each = points.withColumn("mark", F.explode(F.array(*(F.lit(m) for m in marks))))
    best = each.groupBy(series, "mark").agg(F.min(F.struct(F.abs(F.col(x) - F.col("mark")).alias("d"), order, x, y)).alias("p"))
    return best.select(series, "mark", F.col(f"p.{x}").alias(x), F.col(f"p.{y}").alias(y))


def loss_spikes(log: DataFrame, series: str, order: str, loss: str) -> DataFrame:
    """Rows whose loss is over greatest(8, twice the one before), the least loss, by series."""
    before = F.lag(loss).over(Window.partitionBy(series).orderBy(order))
    return log.withColumn("__p", before).groupBy(series).agg(F.count_if(F.col(loss) > F.greatest(F.lit(8.0), F.col("__p") * 2)).alias("spikes"), F.min(loss).alias("least_loss"), F.count(F.lit(1)).alias("n"))


def best_trial(trials: DataFrame, group: str, rate: str, ok: Column, trial: str) -> DataFrame:
    """The fastest trial that went well, the first of equals."""
    best = trials.where(ok).groupBy(group).agg(F.min(F.struct((-F.col(rate)).alias("r"), trial)).alias("b"))
    return best.select(group, F.col(f"b.{trial}").alias(trial), (-F.col("b.r")).alias(rate))


def sample_means(log: DataFrame, group: str, values: list[str], order: str) -> DataFrame:
    """Means of what isn't null, the last row's values, the number of samples."""
    last = F.max(F.struct(order, *values)).alias("__l")
    d = log.groupBy(group).agg(*(F.round(F.avg(v), 6).alias(f"mean_{v}") for v in values), last, F.count(F.lit(1)).alias("samples"))
    return d.select(group, *(f"mean_{v}" for v in values), *(F.col(f"__l.{v}").alias(f"last_{v}") for v in values), "samples")


def curve_summary(points: DataFrame, series: str, tokens: str, loss: str) -> DataFrame:
    """Best and final loss of each run, and whether its final is within TIE of the best run's."""
    d = points.groupBy(series).agg(F.min(loss).alias("best_loss"), F.max(F.struct(tokens, loss)).alias("__f")).select(series, "best_loss", F.col(f"__f.{loss}").alias("final_loss"))
    least = d.agg(F.min("final_loss").alias("__m"))
    return d.join(F.broadcast(least), F.lit(True)).select(series, "best_loss", "final_loss", (F.col("final_loss") - F.col("__m") <= TIE).alias("ties_for_best"))


def milestones(log: DataFrame, marks: list[int], series: str, tokens: str, order: str) -> DataFrame:
    """The first row at which each mark is reached."""
    each = log.withColumn("mark", F.explode(F.array(*(F.lit(m) for m in marks)))).where(F.col(tokens) >= F.col("mark"))
    return each.groupBy(series, "mark").agg(F.min(order).alias("reached"))


def migrate(rate: Column, loss: Column, base: float = BASE_RATE) -> Column:
    """Is it a tenth faster, with a loss that is a number?"""
    return ((rate - base) / base >= GAIN) & loss.isNotNull() & ~F.isnan(loss)


def tokenizer_ratios(texts: DataFrame, domain: str, text: str, n_tokens: str) -> DataFrame:
    """Characters and bytes a token by domain."""
    d = texts.groupBy(domain).agg(F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("bytes"), F.sum(n_tokens).alias("tokens"))
    n = F.greatest(F.lit(1), F.col("tokens"))
    return d.withColumn("chars_per_token", F.round(F.col("chars") / n, 9)).withColumn("bytes_per_token", F.round(F.col("bytes") / n, 9))


def choose_tokenizer(ratios: DataFrame, weights: DataFrame) -> DataFrame:
    """ratios: domain, now, candidate (characters a token). The candidate wins if its weighted mean is BETTER times the present one's and general text keeps GENERAL_LEAST of its own."""
    d = ratios.join(F.broadcast(weights), "domain")
    mean = lambda c: F.sum(F.col("weight") * F.col(c)) / F.sum("weight")
    general = lambda c: F.max(F.when(F.col("domain") == "general", F.col(c)))
    return d.agg(F.round(mean("now"), 9).alias("now"), F.round(mean("candidate"), 9).alias("candidate"), ((mean("candidate") > mean("now") * BETTER) & (general("candidate") >= general("now") * GENERAL_LEAST)).alias("choose_candidate"))


def keep_last(names: DataFrame, group: str, name: str, n: int = 3) -> DataFrame:
    """The last n by name."""
    return names.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(name)))).where(F.col("__n") <= n).drop("__n")


def first_mean(log: DataFrame, group: str, order: str, value: str, k: int) -> DataFrame:
    """The mean of each group's first k values; NaN would be that of none, so a group without values has no row."""
    w = Window.partitionBy(group).orderBy(order)
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).groupBy(group).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def timings(log: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and median of each group's values."""
    return log.groupBy(group).agg(F.avg(value).alias("mean"), F.median(value).alias("median"))


def training_extremes(log: DataFrame, group: str, loss: str, norm: str) -> DataFrame:
    """The least loss and the largest finite gradient norm of each group."""
    finite = F.when(~F.isnan(norm) & (F.abs(norm) != float("inf")), F.col(norm))
    return log.groupBy(group).agg(F.min(loss).alias("least_loss"), F.max(finite).alias("most_norm"))


def compare_curves(log: DataFrame, marks: list[int], order: str, value: str, group: str, a: str, b: str) -> DataFrame:
    """mark, the values of a and b nearest to it (ties: the earlier), and b less a."""
    both = nearest(log.where(F.col(group).isin(a, b)).withColumn("__at", F.col(order)), marks, order, value, group, "__at")
    of = lambda x: F.max(F.when(F.col(group) == x, F.col(value)))
    return both.groupBy("mark").agg(of(a).alias("a"), of(b).alias("b")).withColumn("delta", F.col("b") - F.col("a"))
