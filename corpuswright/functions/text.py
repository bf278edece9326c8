"""Column functions for text, content keys and URLs. All run in the JVM but ``sanitize``'s rare branch."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: one document in so many may go to the validation split.
VAL_BUCKETS = 64
#: White space at either end, with the four information separators.
_BLANK = r"[\s\x1c-\x1f]+"
#: Scheme, authority, path and query of a URL (RFC 3986, appendix B); the fragment is left out.
_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space, as Unicode has it, at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"(?U)^{_BLANK}", ""), f"(?U){_BLANK}$", "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white text."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def nfc(c: Column) -> Column:
    """NFC, in Arrow batches: Spark has no function for it."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.pandas_udf(run, "string")(c)


def sanitize(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace text by valid Unicode in NFC.

    Text whose code points all lie below U+0300 is in NFC already and stays in
    the JVM; of such rows Python gets a null, of the rest the text, in Arrow
    batches and one scan.
    """
    known = F.make_valid_utf8(F.col(text))
    plain = F.coalesce(~F.col(text).rlike("[^\\x{0}-\\x{2ff}]"), F.lit(True))
    return df.withColumn(text, F.coalesce(nfc(F.when(~plain, known)), known))


def content_sha256(text: Column | str) -> Column:
    """Hex SHA-256 of the stripped text's UTF-8; the text is taken to be sanitised."""
    return F.sha2(strip(text), 256)


def normalize_url(url: Column | str) -> Column:
    """Scheme (http if absent) and host in lower case, one leading www. and trailing slashes gone, query kept, fragment dropped; null for blank."""
    u = F.trim(_col(url))
    part = lambda i: F.regexp_extract(u, _URL, i)
    scheme = F.coalesce(F.nullif(F.lower(part(1)), F.lit("")), F.lit("http"))
    host = F.regexp_replace(F.lower(part(2)), r"^www[.]", "")
    path = F.coalesce(F.nullif(F.regexp_replace(part(3), "/+$", ""), F.lit("")), F.lit("/"))
    query = F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise(F.lit(""))
    return F.when(F.coalesce(u, F.lit("")) != "", F.concat(scheme, F.lit("://"), host, path, query))


def source_key(kind: str, value: Column | str) -> Column:
    """``kind:value``, urls normalised; null for a blank value."""
    v = _col(value)
    if kind == "url":
        return F.when(normalize_url(v).isNotNull(), F.concat(F.lit("url:"), normalize_url(v)))
    return F.when(F.coalesce(F.trim(v.cast("string")), F.lit("")) != "", F.concat(F.lit(f"{kind}:"), F.trim(v.cast("string"))))


def in_val_bucket(sha256: Column | str) -> Column:
    """The first 16 hex digits, as a number, are divisible by VAL_BUCKETS: only the last two of them matter."""
    return F.conv(F.substring(_col(sha256), 15, 2), 16, 10).cast("int") % VAL_BUCKETS == 0


def byte_tokens(text: Column | str) -> Column:
    """Tokens of the byte model with its end token."""
    return (F.octet_length(_col(text)) + 1).cast("long")


def training_pieces(text: Column | str, longest: int = 50_000, least: int = 4) -> Column:
    """Paragraphs of ``least`` characters or more; longer ones than ``longest`` are cut at the last line end, else the last space, else hard, until the rest fits."""
    cut = rf"(?s)(.{{1,{longest}}}\z|.{{1,{longest - 1}}}(?=\n)|.{{1,{longest - 1}}}(?=[ ])|.{{1,{longest}}})"
    parts = F.transform(F.split(_col(text), "\n\n"), strip)
    cut_up = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= longest, F.array(p)).otherwise(F.transform(F.regexp_extract_all(p, F.lit(cut), F.lit(1)), strip))))
    return F.filter(cut_up, lambda p: F.length(p) >= least)
