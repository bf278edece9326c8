"""Row predicates: markers, licences, score bands, paths and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.text import is_blank

#: Fixed value: longest document, in characters.
LONGEST = 8 * 1024 * 1024
#: Markers of a shard that is never read.
DENIED_MARKERS = ("data/CC-MAIN-2024-38/000_00041.parquet", "CC-MAIN-2024-38/000_00041")
#: Licences that permit use.
PERMISSIVE = (
    "mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-3-clause-clear", "bsd-2-clause-freebsd", "cc0-1.0", "unlicense", "isc", "0bsd",
    "mit-0", "zlib", "boost-1.0", "artistic-2.0", "python-2.0", "postgresql", "wtfpl", "ncsa", "ms-pl",
)
#: Formats that may and may not be read.
ALLOWED_FORMATS = (".parquet", ".arrow", ".json", ".jsonl", ".json.gz", ".jsonl.gz", ".txt", ".txt.gz", ".csv", ".tsv", ".csv.gz")
DENIED_FORMATS = (".pkl", ".pickle", ".pt", ".pth", ".bin", ".exe", ".so", ".dll", ".dylib", ".sh", ".bat", ".ps1", ".cmd", ".py", ".ipynb")


def hits_denied_marker(*parts: Column) -> Column:
    joined = F.replace(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)), F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for m in DENIED_MARKERS:
        out |= F.contains(joined, F.lit(m))
    return out


def license_is_permissive(license_type: Column, detected: Column) -> Column:
    """The type is permissive, or any detected licence is a permissive one."""
    plain = F.lower(F.trim(license_type)) == "permissive"
    return F.coalesce(plain, F.lit(False)) | F.coalesce(F.exists(detected, lambda x: F.coalesce(F.lower(F.trim(x)).isin(*PERMISSIVE), F.lit(False))), F.lit(False))


def in_score_band(score: Column, least: float, below: float | None = None) -> Column:
    """least <= score < below; a missing score passes only where there is no upper end; one that isn't a number fails."""
    n = score.try_cast("double")
    missing = score.isNull() & F.lit(below is None)
    inside = (n >= least) if below is None else (n >= least) & (n < below)
    return missing | F.coalesce(inside, F.lit(False))


def code_row_is_eligible(license_type: Column, detected: Column, int_score: Column, score: Column, blob_id: Column, least: float = 4, below: float | None = None) -> Column:
    """A permissive row with a blob whose score (the whole one first) lies in the band."""
    return license_is_permissive(license_type, detected) & in_score_band(F.coalesce(int_score.cast("string"), score.cast("string")), least, below) & ~is_blank(blob_id)


def is_usable(text: Column, longest: int = LONGEST) -> Column:
    return ~is_blank(text) & (F.length(text) <= longest)


def tokens_are_valid(ids: Column) -> Column:
    """Not null, and every id fits 16 bits."""
    return F.coalesce(F.forall(ids, lambda x: F.coalesce(x.between(0, 65535), F.lit(False))), F.lit(False))


def is_eval_path(path: Column) -> Column:
    """The file's name begins like a test or validation file's, or a folder is one of theirs."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return p.rlike(r"(^|/)(test|validation|valid)[-_][^/]*$") | p.rlike(r"(^|/)(test|validation|valid|dev)/")


def format_of(path: Column) -> Column:
    """The suffix in lower case, with .gz and the one before it taken together."""
    return F.regexp_extract(F.lower(path), r"((?:[.](?:json|jsonl|txt|csv))?[.]gz|[.][^./\\]+)$", 1)


def format_is_allowed(path: Column) -> Column:
    return format_of(path).isin(*ALLOWED_FORMATS)


def format_is_denied(path: Column) -> Column:
    last = F.regexp_extract(F.lower(path), r"([.][^./\\]+)$", 1)
    return format_of(path).isin(*DENIED_FORMATS) | last.isin(*DENIED_FORMATS)


def is_full_dump_path(dataset: Column, path: Column) -> Column:
    """A path of the whole web dump, in any case of the dataset's name and with either slash."""
    return F.contains(F.lower(F.coalesce(dataset, F.lit(""))), F.lit("fineweb-edu")) & F.startswith(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), F.lit("data/CC-MAIN"))


def counters(docs: DataFrame, group: str, accepted: Column, validation: Column, duplicate: Column, unencodable: Column, tokens: Column) -> DataFrame:
    """Counts of a group's documents by outcome; inspected = train + val + duplicate + skipped + unencodable."""
    return docs.groupBy(group).agg(
        F.count(F.lit(1)).alias("inspected"),
        F.count_if(accepted & ~validation).alias("accepted_train"),
        F.count_if(accepted & validation).alias("accepted_val"),
        F.count_if(duplicate).alias("duplicate"),
        F.count_if(unencodable & ~duplicate).alias("unencodable"),
        F.count_if(~accepted & ~duplicate & ~unencodable).alias("skipped"),
        F.coalesce(F.sum(F.when(accepted, tokens)), F.lit(0)).alias("tokens"),
    )
