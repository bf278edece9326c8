"""Closed forms over columns: schedules, costs, sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cost model, in dollars.
GPU_HOUR, CONTINUE_MAX, HARD_LIMIT, EXPORT_RESERVE, MARGIN = 2.10, 98.0, 100.0, 2.0, 2.0


def learning_rate(step: Column, peak: Column, warmup: int, total: int, floor: Column) -> Column:
    """Linear warm-up, then a cosine down to the floor, then the floor."""
    share = (step - warmup) / F.lit(float(total - warmup))
    cosine = floor + (peak - floor) * 0.5 * (1 + F.cos(share * math.pi))
    return F.when(step < warmup, peak * step / F.lit(float(warmup))).when(step > total, floor).otherwise(cosine)


def perplexity(loss: Column) -> Column:
    """exp(loss); null for null, NaN and infinities."""
    return F.when(loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) != float("inf")), F.exp(loss))


def gpu_hours(tokens: Column, rate: Column) -> Column:
    """Divided as doubles whatever the columns' types, as DuckDB does; Spark would divide a long by a decimal as decimals."""
    return F.when((rate > 0) & (tokens > 0), tokens.cast("double") / rate.cast("double") / 3600.0).otherwise(F.lit(float("inf")))


def projected_cost(spent: Column, preprocess: Column, tokens: Column, rate: Column) -> Column:
    """The fixed dollars are added up first, so that a sum is rounded once."""
    return gpu_hours(tokens, rate) * GPU_HOUR + (F.greatest(spent + preprocess, F.lit(0.0)) + EXPORT_RESERVE)


def rounded(value: Column, places: int) -> Column:
    """The double next to value * 10 ** places without a fraction (halves away from zero), over 10 ** places: DuckDB's round.

    Spark's round goes by the shortest decimals of the value itself, which differ
    where the product is half a unit only as a double.
    """
    scaled = value * float(10**places)
    # A product beyond the largest double leaves the value as it is.
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / float(10**places)).otherwise(value)


def may_continue(total: Column) -> Column:
    return (total <= CONTINUE_MAX) & (total <= HARD_LIMIT - MARGIN)


#: Hours of a domain's packing where nothing is known, dollars of an hour of packing, and of all packing where nothing is known.
UNKNOWN_HOURS, PACK_HOUR, PACK_DEFAULT = 6.0, 1.05, 32.0


def remaining_hours(status: Column, tokens: Column, elapsed: Column, target: Column) -> Column:
    """Hours of packing that a domain still needs, at its speed so far; 0 when complete."""
    known = (F.coalesce(tokens, F.lit(0)) > 0) & (F.coalesce(elapsed, F.lit(0)) > 0)
    left = F.greatest(target - tokens, F.lit(0.0)) / (tokens / elapsed) / 3600.0
    return F.when(status == "complete", 0.0).when(known, left).otherwise(F.lit(UNKNOWN_HOURS))


def packing_cost(elapsed: Column) -> Column:
    """An aggregate: dollars of all packing so far."""
    total = F.coalesce(F.sum(elapsed), F.lit(0.0))
    return F.when(total > 0, total / 3600.0 * PACK_HOUR).otherwise(F.lit(PACK_DEFAULT))


def probation_failure(finite: Column, saved: Column, resumed: Column, rate: Column, total: Column) -> Column:
    """The first rule that a trial run breaks; null if it may go on."""
    return (
        F.when(~finite, "non_finite_loss")
        .when(~saved, "missing_or_invalid_checkpoint")
        .when(~resumed, "checkpoint_reload_failed")
        .when(rate <= 0, "no_measured_throughput")
        .when(~may_continue(total), "projected_over_budget")
    )


def group_learning_rate(step: Column, peak: Column, first_peak: Column, warmup: int, total: int, floor: Column) -> Column:
    """A parameter group's rate: its floor is to its peak as the floor is to the first group's peak."""
    return learning_rate(step, peak, warmup, total, peak * floor / first_peak)


def parameter_count(vocab: Column, width: Column, layers: Column, heads: Column, groups: Column, head_size: Column, inner: Column, tied: Column) -> Column:
    """Weights of a decoder with grouped queries, gated feed-forward, two norms a layer and per-head norms of queries and keys."""
    layer = width * (heads + groups * 2) * head_size + heads * head_size * width + head_size * 2 + width * 2 + width * inner * 3
    return vocab * width * F.when(tied, 1).otherwise(2) + layers * layer + width


def train_flops(parameters: Column, tokens: Column) -> Column:
    return parameters * tokens * 6
