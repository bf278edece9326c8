"""Exact deduplication: the first writer of a content hash or of a source key wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """key and, of its first row by order, ``keep`` as first_*. One partial aggregate: a key of any number of rows is summed where it lies."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *keep)).alias("__f")).select(key, *(F.col(f"__f.{c}").alias(f"first_{c}") for c in [order, *keep]))


def mark_content_duplicates(docs: DataFrame, sha: str = "sha256", order: str = "seq", domain: str = "domain", scope: str = "global") -> DataFrame:
    """Add is_first and first_domain. scope "domain" judges every domain by itself."""
    keys = [sha] if scope == "global" else [domain, sha]
    first = docs.groupBy(*keys).agg(F.min(F.struct(order, domain)).alias("__f"))
    return docs.join(first, keys).withColumn("is_first", F.col(order) == F.col("__f")[order]).withColumn("first_domain", F.col("__f")[domain]).drop("__f")


def duplicate_pairs(marked: DataFrame, domain: str = "domain", kind: str = "content") -> DataFrame:
    """pair (first->this domain), kind, n of rejected rows."""
    pair = F.concat(F.col("first_domain"), F.lit("->"), F.col(domain))
    return marked.where(~F.col("is_first")).groupBy(pair.alias("pair"), F.lit(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def first_by_every_key(docs: DataFrame, keys: str = "source_keys", order: str = "seq") -> DataFrame:
    """Rows that come first for every one of their keys; rows without keys pass.

    A row that is itself rejected still hides later ones here; ``replay`` doesn't let it.
    """
    exploded = docs.select(order, F.explode(keys).alias("key")).where(F.col("key").isNotNull())
    first = exploded.groupBy("key").agg(F.min(order).alias("first"))
    late = exploded.join(first, "key").where(F.col(order) > F.col("first")).select(order).distinct()
    return docs.join(late, order, "left_anti")


def not_in_index(docs: DataFrame, index: DataFrame, sha: str = "sha256") -> DataFrame:
    return docs.join(index.select(sha), sha, "left_anti")


def index_sizes(docs: DataFrame, marked: DataFrame, sha: str = "sha256", keys: str = "source_keys") -> DataFrame:
    content = marked.where("is_first").agg(F.count(F.lit(1)).alias("content"))
    dups = marked.where("not is_first").agg(F.count(F.lit(1)).alias("dups"))
    own = docs.join(marked.where("is_first").select("seq"), "seq", "left_semi").select(F.explode(keys).alias("k")).agg(F.count_distinct("k").alias("keys"))
    # Three single rows.
    return content.join(own, F.lit(True)).join(dups, F.lit(True))


def replay(docs: DataFrame, train_quota: int, val_quota: int, language_quota: dict[str, int] | None = None) -> DataFrame:
    """The strict order-by-order packer, for rows with several keys: seq, outcome (train, val, duplicate_content, duplicate_key, skipped).

    docs: domain, seq, sha256, source_keys, n, in_val, language. Only accepted
    rows enter the index, so the result depends on every earlier one: a domain's
    slim rows (no text) pass through one task in order, in Arrow batches, never held whole.
    """
    limits = language_quota or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, content, keys, train, val, by_language = None, set(), set(), 0, 0, {}
        for pdf in frames:
            outcomes = []
            for r in pdf.itertuples():
                if r.domain != domain:
                    domain, content, keys, train, val, by_language = r.domain, set(), set(), 0, 0, {}
                own = [] if r.source_keys is None else list(r.source_keys)
                if train >= train_quota and val >= val_quota:
                    outcomes.append("skipped")
                elif r.sha256 in content:
                    outcomes.append("duplicate_content")
                elif any(k in keys for k in own):
                    outcomes.append("duplicate_key")
                elif r.in_val and val < val_quota:
                    val += r.n
                    outcomes.append("val")
                elif train < train_quota and by_language.get(r.language, 0) < limits.get(r.language, float("inf")):
                    train += r.n
                    by_language[r.language] = by_language.get(r.language, 0) + r.n
                    outcomes.append("train")
                else:
                    outcomes.append("skipped")
                if outcomes[-1] in ("train", "val"):
                    content.add(r.sha256)
                    keys.update(own)
            yield pd.DataFrame({"domain": pdf["domain"], "seq": pdf["seq"], "outcome": outcomes})

    slim = docs.select("domain", "seq", "sha256", "source_keys", "n", "in_val", "language")
    return slim.repartition("domain").sortWithinPartitions("domain", "seq").mapInPandas(run, "domain string, seq long, outcome string")
