"""Which datasets, prefixes and files may be listed, and chains of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Datasets that are never read, the one whose listing is bound to a prefix, and that prefix.
FORBIDDEN = ("HuggingFaceFW/fineweb", "HuggingFaceFW/fineweb-2")
BOUND_DATASET, BOUND_PREFIX = "HuggingFaceFW/fineweb-edu", "sample/10BT"
#: Fixed value: from this shard on a paper archive holds whole texts.
FIRST_FULL_SHARD = 10


def dataset_is_allowed(dataset: Column) -> Column:
    """Not blank, not forbidden, and of the bound family only the bound dataset's own names."""
    d = F.trim(F.coalesce(dataset, F.lit("")))
    variant = F.startswith(F.lower(d), F.lit("huggingfacefw/fineweb")) & ~F.contains(F.lower(d), F.lit("fineweb-edu"))
    return (d != "") & ~d.isin(*FORBIDDEN) & ~variant


def prefix_is_allowed(dataset: Column, prefix: Column) -> Column:
    return dataset_is_allowed(dataset) & ((dataset != BOUND_DATASET) | F.startswith(F.replace(prefix, F.lit("\\"), F.lit("/")), F.lit(BOUND_PREFIX)))


def check_prefix(spark: SparkSession, dataset: str, prefix: str) -> None:
    """ValueError for a dataset or prefix that may not be listed."""
    if not spark.range(1).select(prefix_is_allowed(F.lit(dataset), F.lit(prefix))).first()[0]:
        raise ValueError(f"may not be listed: {dataset!r} {prefix!r}")


def listed(files: DataFrame, dataset: str, prefix: str, suffixes: tuple[str, ...] = (".parquet",)) -> DataFrame:
    """Files of a catalogue (dataset_id, path, ...) under a prefix with one of the suffixes; of the bound dataset only its own sample."""
    check_prefix(files.sparkSession, dataset, prefix)
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    ends = F.lit(False)
    for s in suffixes:
        ends |= F.endswith(path, F.lit(s))
    out = files.where((F.col("dataset_id") == dataset) & F.startswith(path, F.lit(prefix)) & ends)
    return out.where(F.startswith(path, F.lit(f"{BOUND_PREFIX}/"))) if dataset == BOUND_DATASET else out


def folder_files(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """dataset_id, path (below the folder), size of the files in a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.lit(dataset).alias("dataset_id"), F.substring_index("path", f"/{base}/", -1).alias("path"), F.col("length").alias("size"))


def first_with_rows(chain: list[DataFrame]) -> DataFrame:
    """The first source that has a row, else the last."""
    for df in chain[:-1]:
        if df.limit(1).count():
            return df
    return chain[-1]


def paper_rows(df: DataFrame, shards: list[int], most: int = 15_000) -> DataFrame:
    """The first ``most`` rows of each wanted shard with a text, of whole texts only unless a shard of abstracts is wanted. df: shard, row_index, id, source, text. Adds native_id and source_keys."""
    from corpuswright.functions.text import is_blank
    from corpuswright.sources.scans import top_rows

    rows = df.where(F.col("shard").isin(*shards) & ~is_blank("text"))
    if min(shards) >= FIRST_FULL_SHARD:
        rows = rows.where(F.startswith(F.coalesce("source", F.lit("")), F.lit("s2orc")))
    rows = top_rows(rows, "shard", "row_index", most)
    native = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.concat_ws(":", F.lit("row"), "shard", "row_index"))
    return rows.withColumn("native_id", native).withColumn("source_keys", F.array(F.concat(F.lit("s2:"), native)))
