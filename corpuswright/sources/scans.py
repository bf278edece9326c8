"""Readers of source files, all to the same row: domain, dataset_id, native_id, text, source_keys, language, extra, seq."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuswright.functions.text import is_blank, source_key
from corpuswright.operators.filters import code_row_is_eligible, hits_denied_marker

#: Fixed value: column names that hold text, by preference.
TEXT_COLUMNS = ("text", "article", "body", "article_text", "content", "abstract", "summary", "document")
#: Fixed value: columns that a text table keeps besides its text.
EXTRA_COLUMNS = ("id", "metadata", "file_path", "url", "dump")
#: Fixed value: bytes of the longest line of a gzip JSON file; longer ones are dropped.
LONGEST_LINE = 16 * 1024 * 1024

SOURCE_DOC = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("native_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source_keys", T.ArrayType(T.StringType())),
        T.StructField("language", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source_ord", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("row_index", T.LongType()),
    ]
)


def text_column(names: list[str]) -> str:
    """The preferred text column, else the first."""
    return next((c for c in TEXT_COLUMNS if c in names), names[0])


def keep_text_rows(df: DataFrame) -> DataFrame:
    """Without rows whose text is blank; tables without a text column pass whole."""
    return df.where(~is_blank("text")) if "text" in df.columns else df


def _numbered(df: DataFrame, order: Column) -> DataFrame:
    """row_index by file, from 0."""
    return df.withColumn("row_index", (F.row_number().over(Window.partitionBy("path").orderBy(order)) - 1).cast("long"))


def _read(spark: SparkSession, path: str, kind: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        # Parquet numbers the rows of a file itself.
        return reader.parquet(path).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))
    if kind == "csv":
        df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif path.lower().endswith(".gz"):
        known = spark.createDataFrame([], schema).schema if schema else spark.read.option("ignoreCorruptFiles", True).json(path).schema
        lines = spark.read.option("ignoreCorruptFiles", True).text(path).where(F.octet_length("value") <= LONGEST_LINE)
        rows = lines.select(F.from_json("value", known).alias("row"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("__at"))
        df = rows.where(F.coalesce(*(F.col(f"row.`{c}`").cast("string") for c in known.names)).isNotNull()).select("row.*", "path", "__at")
        return _numbered(df, F.col("__at")).drop("__at")
    else:
        df = reader.option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(path)
    return _numbered(df.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("__at")), F.col("__at")).drop("__at")


def text_table(spark: SparkSession, path: str, domain: str, dataset_id: str, kind: str | None = None, schema: T.StructType | None = None, source_ord: int = 0) -> DataFrame:
    """A locked table of texts (Parquet, CSV, JSON lines, gzip or not): native_id is path:row_index, the row's place among all rows of its file.

    Malformed JSON lines, lines of gzip files over LONGEST_LINE bytes and the cut tail of a damaged gzip file are dropped, and rows whose path, file_path, metadata or id names a denied shard.
    """
    name = path.lower().removesuffix(".gz")
    kind = kind or ("parquet" if name.endswith(".parquet") else "csv" if name.endswith(".csv") else "json")
    df = _read(spark, path, kind, schema)
    own = [c for c in df.columns if c not in ("path", "row_index")]
    text = text_column(own)
    extras = [c for c in EXTRA_COLUMNS if c in own and c != text]
    pairs = [x for c in extras for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    extra = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    denied = hits_denied_marker(F.col("path"), *(F.col(f"`{c}`").cast("string") for c in ("file_path", "metadata", "id") if c in extras))
    out = df.where(~denied).select(
        F.lit(domain).alias("domain"), F.lit(dataset_id).alias("dataset_id"), F.concat_ws(":", "path", F.col("row_index").cast("string")).alias("native_id"), F.col(f"`{text}`").cast("string").alias("text"),
        F.array(F.concat(F.lit("id:"), F.concat_ws(":", "path", F.col("row_index").cast("string")))).alias("source_keys"), F.lit(None).cast("string").alias("language"), extra.alias("extra"), F.lit(source_ord).alias("source_ord"), "path", "row_index",
    )
    return out.where(~is_blank("text"))


def web_documents(df: DataFrame, domain: str = "general", dataset_id: str = "web") -> DataFrame:
    """Rows with id, url, text to source documents: native_id is the id, else the url, else web:seq; keys are the url's and the id's."""
    keys = F.filter(F.array(source_key("url", "url"), source_key("id", "id")), lambda x: x.isNotNull())
    native = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("web:"), F.col("seq").cast("string")))
    return keep_text_rows(df).select(F.lit(domain).alias("domain"), F.lit(dataset_id).alias("dataset_id"), native.alias("native_id"), "text", keys.alias("source_keys"), "seq")


def code_documents(rows: DataFrame, blobs: DataFrame, domain: str = "code", dataset_id: str = "code", least: float = 4, below: float | None = None) -> DataFrame:
    """Eligible rows (license_type, detected_licenses, int_score, score, blob_id, seq) with the texts of their blobs (blob_id, text).

    Rows are filtered before they meet a text; those without a blob or with a blank text go. Rows that share a blob are all kept; order is seq.
    """
    own = rows.where(code_row_is_eligible(*(F.col(c) for c in ("license_type", "detected_licenses", "int_score", "score", "blob_id")), least, below)).select("blob_id", "seq")
    met = own.join(blobs.where(~is_blank("text")).select("blob_id", "text"), "blob_id")
    return met.select(F.lit(domain).alias("domain"), F.lit(dataset_id).alias("dataset_id"), F.col("blob_id").alias("native_id"), "text", F.array(source_key("swh", "blob_id")).alias("source_keys"), "seq")


def top_rows(df: DataFrame, shard: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each shard."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(shard).orderBy(order))).where(F.col("__nth") <= most).drop("__nth")


def union_all(sources: list[DataFrame], start: int = 0, skip: int = 0) -> DataFrame:
    """Sources in their order, from number ``start`` on; skip drops the first rows of that one only."""
    parts = []
    for i, df in enumerate(sources[start:], start):
        df = df.withColumn("source_ord", F.lit(i))
        if i == start and skip:
            # The last row to skip is found by places alone; texts are only filtered.
            at = F.struct("path", "row_index")
            last = df.select(at.alias("at")).orderBy("at").limit(skip).agg(F.max("at").alias("at")).first()["at"]
            if last is not None:
                df = df.where((F.col("path") > last["path"]) | (F.col("path") == last["path"]) & (F.col("row_index") > last["row_index"]))
        parts.append(df)
    return reduce(DataFrame.unionByName, parts)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A training log: JSON lines with kind, tokens, losses; lines that don't parse are dropped."""
    schema = "kind string, iter long, step long, tokens long, wall_s double, loss double, train_loss double, val_loss double, learning_rate double, iter_time_s double, grad_norm double, val_by_domain map<string,double>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def val_points(log: DataFrame) -> DataFrame:
    return log.where("val_loss is not null")


def train_points(log: DataFrame) -> DataFrame:
    return log.withColumn("train_loss", F.coalesce("train_loss", "loss")).where("train_loss is not null and tokens is not null")


def synthetic(spark: SparkSession, domain: str, n: int, seed: int = 0) -> DataFrame:
    """Seeded template documents of a domain."""
    words = F.array(*(F.lit(w) for w in "alpha beta gamma delta model field proof loop graph energy cell theorem".split()))
    pick = lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(seed), i), F.size(words)) + 1).cast("int"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), pick), " ")
    name = F.concat(F.lit(f"synthetic:{domain}:"), F.col("id").cast("string"))
    return spark.range(n).select(F.lit(domain).alias("domain"), F.lit("synthetic").alias("dataset_id"), name.alias("native_id"), F.concat(F.lit(f"{domain} document "), F.col("id").cast("string"), F.lit(": "), body).alias("text"), F.array(F.concat(F.lit("id:"), name)).alias("source_keys"), F.col("id").alias("seq"))


def resume_cursor(state: dict | None, n_sources: int) -> tuple[int, int]:
    """(source to start at, rows to skip in it) from a domain's saved counters.

    A first source whose rows are four fifths duplicates by now is used up: the next one begins, if there is one.
    """
    s = {k: int(v or 0) for k, v in (state or {}).items()}
    if s.get("start_source", 0) >= 1:
        return s["start_source"], s.get("source_stream_index", 0)
    inspected = s.get("docs_inspected", 0)
    used_up = s.get("tokens_train", 0) > 0 and inspected >= 1000 and s.get("docs_duplicate", 0) >= 0.8 * inspected
    return (1, 0) if used_up and n_sources > 1 else (0, s.get("stream_index", 0))


def marker_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose name, or a line of which, holds a denied marker; no file is read as one value."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").where(hits_denied_marker(F.col("path")))
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    return names.unionByName(lines.where(hits_denied_marker(F.col("value"))).select("path")).distinct()
