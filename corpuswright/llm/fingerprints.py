"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into words (lower-cased runs of letters and digits; in scripts
that don't part words by spaces every character is one); every run of ``K`` words has a Karp-Rabin polynomial hash; of each window of ``WINDOW``
consecutive hashes the smallest is chosen, the rightmost of equal ones, and kept
with its position.  Two texts that share a run of ``K + WINDOW - 1`` words or
more therefore share a chosen hash.

A text costs three array passes inside its own row (word residues, keys of the
grams, window minima): no row per word, no shuffle, no Python.

Defined results: null text is the empty text; an empty text has the empty
fingerprint; a text of symbols only counts as one word; fewer than ``K`` words
make one gram; fewer than ``WINDOW`` grams make one window; the likeness of two
empty fingerprints is 1, of an empty and another one 0; equal hashes in a window
give the rightmost; repeated rows have equal fingerprints; very long texts are
read whole, in arrays of their own row.  Extra columns pass through, and the
helper columns start with ``__fp_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
WINDOW = 4
PRIME = 2147483647  # 2**31 - 1
WORD_RANGE = 1 << 28  # a word's residue times a power of the base is under 2**59: MAX_TERMS of them fit a signed long
MAX_TERMS = 12
BASE = 1000003
#: Scripts whose writing has no spaces between words.
_UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))


def winnow(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW, unit: str = "word") -> DataFrame:
    """Add ``out``: array<long>, each a chosen hash and its position (see ``hashes`` and ``positions``).

    unit "char" takes code points instead of words.
    """
    p = f"__fp_{out}"
    whole = F.coalesce(F.col(text), F.lit(""))
    lower, gap = F.lower(whole), r"[^\p{L}\p{N}]+"
    # Beside a character of an unspaced script a text is cut too.
    words = F.when(lower.rlike(f"[{_UNSPACED}]"), F.split(lower, rf"{gap}|(?<=[{_UNSPACED}])|(?=[{_UNSPACED}])")).otherwise(F.split(lower, gap))
    units = F.array_remove(words if unit == "word" else F.split(lower, ""), "")
    residue = lambda x: F.pmod(F.xxhash64(x), F.lit(WORD_RANGE))
    df = df.withColumn(f"{p}_h", F.transform(units, residue))
    df = df.withColumn(f"{p}_h", F.when((F.size(f"{p}_h") == 0) & (whole != ""), F.array(residue(whole))).otherwise(F.col(f"{p}_h")))
    h = F.col(f"{p}_h")
    powers = [pow(BASE, k - 1 - j, PRIME) for j in range(k)]

    def chosen_key(gram: Column, at: Column) -> Column:
        """The hash above, the position counted backwards below: the least key of a window is its rightmost smallest hash."""
        return (gram % F.lit(PRIME)) * F.lit(1 << 32) + (F.lit((1 << 32) - 1) - at)

    def roll(i: Column) -> Column:
        total = F.get(h, i) * F.lit(powers[0])
        for j in range(1, k):
            total = (total if j % MAX_TERMS else total % F.lit(PRIME)) + F.get(h, i + j) * F.lit(powers[j])
        return chosen_key(total, i)

    short = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * F.lit(BASE) + x) % F.lit(PRIME))
    df = df.withColumn(f"{p}_v", F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), roll)).when(F.size(h) > 0, F.array(chosen_key(short, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    v = F.col(f"{p}_v")
    least = lambda i: F.least(*(F.get(v, i + j) for j in range(window))) if window > 1 else F.get(v, i)
    df = df.withColumn(out, F.when(F.size(v) >= window, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(v) - window), least))).when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(v))
    return df.drop(f"{p}_h", f"{p}_v")


def hashes(chosen: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, 32)))


def positions(chosen: Column) -> Column:
    """Of each chosen gram the number of its first word, from 0."""
    return F.transform(chosen, lambda v: F.lit((1 << 32) - 1) - v.bitwiseAND(F.lit((1 << 32) - 1)))


def as_string(chosen: Column) -> Column:
    """The chosen keys (hash * 2**32 + 2**32 - 1 - position) in text order."""
    return F.concat_ws(" ", chosen.cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def _bucket(key: Column, bounds: list[int], strict: bool = False) -> Column:
    """How many of the ascending bounds are <= key (strict: below it), by halving; the bounds are one literal, however many."""
    if not bounds:
        return F.lit(0)
    all_ = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def half(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        at = F.get(all_, mid)
        up = (s["lo"] < s["hi"]) & ((at < key) if strict else (at <= key))
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    steps = F.array(*(F.lit(i) for i in range(len(bounds).bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), half, lambda s: s["lo"])


def with_next(df: DataFrame, key: str, text: str, steps, buckets: int | None = None) -> DataFrame:
    """Add columns of the next row by descending key (after the last: the first's), in one shuffle. key: an integer column.

    steps(df, lead) adds them, with lead(column) as the next row's value; it may derive columns first.

    Keys are split at approximate quantiles; the first row of each bucket is sent to the one before it
    too, so that no bucket waits for another and none holds more than its share.  Equal keys follow in
    the order of their texts; null keys come last.  Only the quantiles (one key for each bucket) reach the driver.
    """
    spark = df.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = df.select(F.percentile_approx(key, [(i + 1) / n for i in range(n - 1)] or [0.5], 100 * n).alias("q"), F.max(key).alias("top"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).first()
    # Bucket i (from 0) holds the keys above bounds[i - 1], up to bounds[i] itself: bounds[i] is the first of its bucket when descending.
    bounds = sorted(set(quantiles["q"] or []))
    top = quantiles["top"]
    if top is not None and (not bounds or bounds[-1] < top):
        bounds.append(top)
    last = len(bounds) if quantiles["nulls"] else None
    below = _bucket(F.col(key), bounds, strict=True)
    df = df.withColumn("__fp_b", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(below)).withColumn("__fp_ghost", F.lit(0))
    head = _bucket(F.col(key), bounds) > F.col("__fp_b")
    # Descending, bucket b is followed by b - 1, the lowest one by the nulls' (-1) if there are any, the last by the highest.
    final = -1 if last is not None else 0
    ghosts = F.when(head, F.when(F.col("__fp_b") == len(bounds) - 1, F.lit(final)).otherwise(F.lit(None)))
    after = F.when(head & (F.col("__fp_b") < len(bounds) - 1), F.col("__fp_b") + 1)
    copies = F.filter(F.array(F.struct(F.col("__fp_b").alias("b"), F.lit(0).alias("g")), F.struct(after.cast("int").alias("b"), F.lit(1).alias("g")), F.struct(ghosts.cast("int").alias("b"), F.lit(2).alias("g"))), lambda x: x["b"].isNotNull())
    if last is not None:
        nulls = F.array(F.struct(F.lit(-1).alias("b"), F.lit(0).alias("g")), *([F.struct(F.lit(0).alias("b"), F.lit(1).alias("g"))] if bounds else [F.struct(F.lit(-1).alias("b"), F.lit(2).alias("g"))]))
        copies = F.when(F.col(key).isNull(), nulls).otherwise(copies)
    df = df.withColumn("__fp_c", F.explode(copies)).withColumn("__fp_b", F.col("__fp_c.b")).withColumn("__fp_ghost", F.col("__fp_c.g")).drop("__fp_c")
    w = Window.partitionBy("__fp_b").orderBy(F.col("__fp_ghost"), F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first())
    return steps(df, lambda c: F.lead(c).over(w)).where(F.col("__fp_ghost") == 0).drop("__fp_b", "__fp_ghost")


def edited(d: DataFrame) -> DataFrame:
    """Add ``edited``: text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of next_text."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))


def op1_query(spark, sf_dir: str) -> DataFrame:
    def steps(d: DataFrame, lead) -> DataFrame:
        d = winnow(d.withColumn("next_text", lead("text")), "text", "fp").withColumn("h", hashes(F.col("fp")))
        return d.withColumn("h_n", lead("h"))

    d = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", steps)
    d = d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    d = edited(d).drop("text", "next_text").withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    d = winnow(d, "edited", "fp_e").drop("edited").withColumn("h_e", hashes(F.col("fp_e")))
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("fp_e")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("h_e")).alias("near_edited"),
        likeness(F.col("h"), F.col("h_n")).alias("near_next"),
        F.size("fp").alias("n_chosen"),
    )
