"""Which files of a source may be read: deny list, lock and scan verdicts, in one pass over the file catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuswright.operators.filters import format_is_allowed, format_is_denied, is_eval_path, is_full_dump_path

#: Statuses of security scans.
HARD_DENY = ("unsafe", "infected", "malware", "unwanted")
PENDING = ("unscanned", "queued", "scanning", "error", "unknown", "")


def deny_matches(files: DataFrame, denylist: DataFrame) -> DataFrame:
    """dataset_id, path, deny_ord: the first entry that hits a file, by path or digest in its dataset, by digest in any other.

    The two ways are two equi-joins, united; the least entry number wins.
    """
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    f = files.select("dataset_id", "path", slashes(F.col("path")).alias("plain"), F.lower("sha256").alias("sha256"))
    d = denylist.select(F.col("dataset_id").alias("d_dataset"), slashes(F.col("path")).alias("d_path"), F.lower("sha256").alias("d_sha"), "entry_ord")
    by_path = f.join(d.where("d_path is not null"), (F.col("dataset_id") == F.col("d_dataset")) & (F.col("plain") == F.col("d_path")))
    by_sha = f.where("sha256 <> ''").join(d.where("d_sha <> ''"), F.col("sha256") == F.col("d_sha"))
    return by_path.unionByName(by_sha).groupBy("dataset_id", "path").agg(F.min("entry_ord").alias("deny_ord"))


def lock_entries(lock: DataFrame) -> DataFrame:
    """The first locked entry of each dataset and path. lock: source_ord, dataset_id, revision, path, sha256, status, reviewed; av_status where known."""
    if "av_status" not in lock.columns:
        lock = lock.withColumn("av_status", F.lit(None).cast("string"))
    nth = F.row_number().over(Window.partitionBy("dataset_id", "path").orderBy("source_ord"))
    own = lock.withColumn("__n", nth).where("__n = 1")
    return own.select("dataset_id", "path", F.col("sha256").alias("lock_sha"), F.col("status").alias("lock_status"), F.col("av_status").alias("lock_av"), F.col("reviewed").alias("lock_reviewed"), F.lit(True).alias("locked"))


def expected_revisions(lock: DataFrame) -> DataFrame:
    return lock.groupBy("dataset_id").agg(F.min_by("revision", "source_ord").alias("lock_revision"))


def verdict_of(reviewed: bool = False) -> tuple[Column, Column]:
    """(verdict, reason) by the first rule that holds; over the columns that ``verdicts`` joins."""
    status, av = F.lower(F.coalesce("security_status", F.lit(""))), F.lower(F.coalesce("av_status", F.lit("")))
    known = F.lit(reviewed) | F.coalesce("lock_reviewed", F.lit(False))
    rules = [
        (F.col("lock_revision").isNotNull() & (F.coalesce("revision", F.lit("")) != "") & (F.col("revision") != F.col("lock_revision")), "mismatch", "revision differs from the lock"),
        (F.col("deny_ord").isNotNull(), "denied", "deny list"),
        (is_full_dump_path(F.col("dataset_id"), F.col("path")), "denied", "full dump"),
        (format_is_denied(F.col("path")) | ~format_is_allowed(F.col("path")), "denied", "format"),
        ((F.coalesce("lock_sha", F.lit("")) != "") & (F.coalesce("sha256", F.lit("")) != "") & (F.lower("lock_sha") != F.lower("sha256")), "mismatch", "digest differs from the lock"),
        (status.isin(*HARD_DENY) | av.isin(*HARD_DENY), "denied", "scan"),
        ((status == "safe") | (av == "safe"), "approved", "scanned"),
        (((F.lower(F.coalesce("lock_status", F.lit(""))) == "safe") | (F.lower(F.coalesce("lock_av", F.lit(""))) == "safe")) & (status == "") & (av == ""), "approved", "pinned by the lock"),
        ((status == "") & (av == ""), None, "not scanned"),
        (status.isin(*PENDING) | av.isin(*PENDING), None, "scan pending"),
    ]
    verdict = reason = None
    for hit, kind, why in rules:
        kind = F.when(known, "approved").otherwise("unresolved") if kind is None else F.lit(kind)
        verdict = F.when(hit, kind) if verdict is None else verdict.when(hit, kind)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    return verdict.otherwise(F.when(known, "approved").otherwise("unresolved")), reason.otherwise("unexpected status")


def verdicts(files: DataFrame, denylist: DataFrame, lock: DataFrame, reviewed: bool = False) -> DataFrame:
    """files: domain, dataset_id, revision, path, size, sha256, security_status, av_status. Adds verdict, reason."""
    joined = files.join(deny_matches(files, denylist), ["dataset_id", "path"], "left").join(lock_entries(lock), ["dataset_id", "path"], "left").join(expected_revisions(lock), "dataset_id", "left")
    verdict, reason = verdict_of(reviewed)
    return joined.select(*files.columns, "locked", verdict.alias("verdict"), reason.alias("reason"))


def fetchable(judged: DataFrame, with_lock: bool) -> DataFrame:
    """Files to read. With a lock, every locked file must be approved; without one, denied files are left out. Anything else that isn't approved is an error."""
    rows = judged.where("locked") if with_lock else judged.where("verdict <> 'denied'")
    checked = F.when(F.col("verdict") == "approved", F.col("path")).otherwise(F.raise_error(F.concat(F.lit("not approved: "), F.col("path"), F.lit(" "), F.col("verdict"))))
    return rows.withColumn("path", checked)


def domain_audit(judged: DataFrame) -> DataFrame:
    """Counts of verdicts by domain, and whether it passes: something approved, nothing unresolved or mismatched."""
    n = lambda k: F.count_if(F.col("verdict") == k)
    return judged.groupBy("domain").agg(n("approved").alias("approved"), n("denied").alias("denied"), n("unresolved").alias("unresolved"), n("mismatch").alias("mismatch"), ((n("approved") > 0) & (n("unresolved") == 0) & (n("mismatch") == 0)).alias("passed"))


def canaries(denylist: DataFrame, lock: DataFrame) -> DataFrame:
    """The verdict of every entry of the deny list, judged as a file of its own (live metadata missing)."""
    files = denylist.select(F.lit(None).cast("string").alias("domain"), "dataset_id", F.lit(None).cast("string").alias("revision"), "path", F.lit(None).cast("long").alias("size"), "sha256", F.lit(None).cast("string").alias("security_status"), F.lit(None).cast("string").alias("av_status"))
    return verdicts(files.distinct(), denylist, lock).select("dataset_id", "path", "verdict")


def audit_passes(audited: DataFrame, judged_canaries: DataFrame) -> DataFrame:
    """One row, passed: every domain passes, and there are canaries, all of them denied."""
    ok = judged_canaries.agg((F.count(F.lit(1)) > 0).alias("any"), F.coalesce(F.bool_and(F.col("verdict").eqNullSafe(F.lit("denied"))), F.lit(False)).alias("denied"))
    return audited.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("domains")).join(F.broadcast(ok), F.lit(True)).select((F.col("domains") & F.col("any") & F.col("denied")).alias("passed"))


def locked_verdicts(judged: DataFrame, lock: DataFrame) -> DataFrame:
    """dataset_id, path, verdict of every locked file; unresolved where the live listing lacks it."""
    own = lock.select("dataset_id", "path").distinct()
    return own.join(judged.select("dataset_id", "path", "verdict"), ["dataset_id", "path"], "left").select("dataset_id", "path", F.coalesce("verdict", F.lit("unresolved")).alias("verdict"))


def pinned(candidates: DataFrame, floor: int) -> DataFrame:
    """The files that a lock pins, by domain. candidates: domain, role (primary, supplement, fallback), source_ord, dataset_id, path, size, verdict, budget (bytes of a source, null: no end).

    Of each source the approved files that are no test splits, in order of
    their paths, until one would exceed the budget (the first always stays).
    Supplements stay where the primary sources have fewer than ``floor`` bytes;
    fallbacks where nothing else has a file, and then only the first source that has.
    """
    source = ["domain", "role", "source_ord", "dataset_id"]
    good = candidates.where((F.col("verdict") == "approved") & ~is_eval_path(F.col("path"))).withColumn("size", F.coalesce("size", F.lit(0))).withColumn("__source", F.concat_ws(" ", *source))
    files = within_budget(good, "__source", "path", "size", F.coalesce("budget", F.lit(1 << 62))).drop("__source")
    own = files.groupBy("domain").agg(F.coalesce(F.sum(F.when(F.col("role") == "primary", F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("role") == "primary").alias("n"), F.count_if(F.col("role") == "supplement").alias("more"), F.min(F.when(F.col("role") == "fallback", F.col("source_ord"))).alias("first"))
    short = F.col("bytes") < floor
    stays = (F.col("role") == "primary") | (F.col("role") == "supplement") & short | (F.col("role") == "fallback") & (F.col("n") + F.when(short, F.col("more")).otherwise(0) == 0) & (F.col("source_ord") == F.col("first"))
    return files.join(own, "domain").where(stays).select(*source, "path", "size")


def missing_live(lock: DataFrame, live: DataFrame) -> DataFrame:
    """Locked files that the live listing lacks."""
    return lock.join(live.select("dataset_id", "path"), ["dataset_id", "path"], "left_anti")


def within_budget(files: DataFrame, group: str, order: str, size: str, budget: Column) -> DataFrame:
    """Files in order until the first that would exceed the budget of bytes; the first file of a group is always taken. A catalogue's group is a list of files."""
    w = Window.partitionBy(group).orderBy(order)
    d = files.withColumn("__before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.row_number().over(w))
    over = F.when((F.col("__n") > 1) & (F.col("__before") + F.col(size) > budget), F.col("__n"))
    d = d.withColumn("__stop", F.min(over).over(Window.partitionBy(group)))
    return d.where(F.col("__stop").isNull() | (F.col("__n") < F.col("__stop"))).drop("__before", "__n", "__stop")


def lock_of(approved: DataFrame) -> DataFrame:
    """A nested lock, a row for each domain: dataset, revision, files."""
    return approved.groupBy("domain", "dataset_id", "revision").agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "size"))).alias("files"))


def flat_lock(nested: DataFrame) -> DataFrame:
    return nested.select("domain", "dataset_id", "revision", F.posexplode("files").alias("ord", "f")).select("domain", "dataset_id", "revision", "ord", "f.path", "f.sha256", "f.size")
