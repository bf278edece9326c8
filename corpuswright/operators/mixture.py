"""Sampling of training windows from domains by weight, and text prefixes under character budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.operators.prefix import prefix_sum
from corpuswright.operators.split import DOMAINS


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """Exactly the known domains, with a positive sum; scaled to sum 1."""
    if set(weights) != set(DOMAINS):
        raise ValueError(f"missing {sorted(set(DOMAINS) - set(weights))}, unknown {sorted(set(weights) - set(DOMAINS))}")
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {d: weights[d] / total for d in DOMAINS}


def epoch_counts(sizes: DataFrame, n: int) -> DataFrame:
    """domain, take: weight * n, rounded half to even, the last domain takes what is left. sizes: domain, ord, windows, weight, a row for each domain."""
    present = sizes.where("windows > 0")
    total = present.agg(F.sum("weight").alias("__w"), F.max("ord").alias("__last"))
    p = present.join(F.broadcast(total), F.lit(True)).withColumn("take", F.bround(F.col("weight") / F.col("__w") * n).cast("long"))
    before = p.where("ord < __last").agg(F.coalesce(F.sum("take"), F.lit(0)).alias("__b"))
    return p.join(F.broadcast(before), F.lit(True)).select("domain", "ord", "windows", F.when(F.col("ord") == F.col("__last"), F.lit(n) - F.col("__b")).otherwise(F.col("take")).alias("take"))


def epoch_assignments(sizes: DataFrame, n: int, seed: int, epoch: int) -> DataFrame:
    """pos, domain, local: the windows of an epoch in training order.

    A domain's windows come in an order of their hashes with seed and epoch,
    cut or repeated to its count; all are mixed by another hash.  Ranks come
    from sorts of (hash, local) ranges, no domain is gathered in one task.
    """
    counts = epoch_counts(sizes, n)
    # A window is taken floor(take / windows) times, and those with the least hashes once more.
    slots = counts.where("take > 0").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)))
    local = counts.where("take > 0").withColumn("local", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1))).withColumn("h", F.xxhash64(F.lit(seed), F.lit(epoch), "domain", "local"))
    ranked = rank_by_hash(local.select("domain", "local", "h"), "domain", "h", "local")
    picked = slots.withColumn("rank", F.col("slot") % F.col("windows")).join(ranked, ["domain", "rank"]).withColumn("mix", F.xxhash64(F.lit(seed), F.lit(epoch), F.lit("mix"), "domain", "slot"))
    all_ = rank_by_hash(picked.withColumn("__one", F.lit(0)).select(F.col("__one").alias("whole"), "domain", "local", "slot", "mix"), "whole", "mix", "slot")
    return all_.select(F.col("rank").alias("pos"), "domain", "local")


def rank_by_hash(df: DataFrame, group: str, h: str, tie: str, slices: int = 1024) -> DataFrame:
    """Add rank (from 0) by hash within the group: counts by slices of the hash range, then ranks inside slices."""
    from pyspark.sql.window import Window

    d = df.withColumn("__s", F.floor(F.col(h).cast("double") / (2.0**64 / slices)).cast("long"))
    before = Window.partitionBy(group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(group, "__s").agg(F.count(F.lit(1)).alias("__c")).select(group, "__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__s").orderBy(h, tie)
    return d.join(starts, [group, "__s"]).withColumn("rank", F.col("__before") + F.row_number().over(inside) - 1).drop("__s", "__before")


def resume(assignments: DataFrame, start: int) -> DataFrame:
    """What is left of an epoch after ``start`` items."""
    return assignments.where(F.col("pos") >= start)


def cycle(items: Column, n: int) -> tuple[Column, Column]:
    """Epoch and place in it of an item's number."""
    return F.floor(items / n), items % n


def take_chars(docs: DataFrame, budget: int, order: str = "seq", text: str = "text", blank: Column | None = None) -> DataFrame:
    """Documents from the first on until their lengths reach the budget; the last one is kept whole. ``blank`` says which to leave out."""
    d = docs if blank is None else docs.where(~blank)
    d = prefix_sum(d.withColumn("whole", F.lit(0)), ["whole"], order, F.length(text), "chars_before")
    return d.where(F.col("chars_before") < budget).drop("whole")


def joined_text(docs: DataFrame, order: str = "seq", text: str = "text", between: str = "\n\n") -> DataFrame:
    """One text of few documents (a sample of bounded size), in order."""
    return docs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), between).alias("text"))


def char_budgets(chars: DataFrame, n: int) -> DataFrame:
    """domain, budget = int(weight * n), and how often its text is gone through. chars: domain, chars, weight."""
    return chars.select("domain", F.floor(F.col("weight") * n).cast("long").alias("budget"), "chars").withColumn("rounds", F.when(F.col("chars") > 0, F.ceil(F.col("budget") / F.col("chars"))).otherwise(0).cast("long"))


def mixed_pieces(docs: DataFrame, budgets: DataFrame, order: str = "seq", text: str = "text") -> DataFrame:
    """domain, round, order, place, text: each domain's documents one after another, gone through again until its budget of characters is full; the last piece is cut.

    budgets: domain, budget, chars, rounds, as char_budgets gives them. place is
    the piece's first character among its domain's. Null and empty texts give no
    piece; a domain without text or budget none.
    """
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    d = prefix_sum(docs.select("domain", order, text, n.alias("n")).where("n > 0"), ["domain"], order, "n", "before")
    d = d.join(budgets.select("domain", "budget", "chars"), "domain").where("before < budget")
    d = d.withColumn("round", F.explode(F.expr("sequence(0L, (budget - before - 1) div chars)"))).withColumn("place", F.expr("round * chars + before"))
    return d.select("domain", "round", order, "place", F.substring(text, F.lit(1), F.least("n", F.col("budget") - F.col("place")).cast("int")).alias(text))


def render_dialogues(turns: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, text: user and assistant turns in order, others dropped, blank ones too; at most ``most`` conversations by id. A conversation is one row by contract."""
    role = F.when(F.lower("role").isin("user", "human"), "User").when(F.lower("role").isin("assistant", "gpt"), "Assistant")
    kept = turns.withColumn("__r", role).where(F.col("__r").isNotNull() & (F.trim("text") != ""))
    out = kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("__r", F.lit(": "), F.trim("text")).alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return out if most is None else out.orderBy("conv_id").limit(most)
