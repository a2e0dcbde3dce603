"""Recorded plans, sessions and file manifests: statistics, hot sets, reuse of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.ranking import age_decay, session_boost
from quillspan.sources.files import IGNORED_PATH, language_of
from quillspan.sources.tables import latest, normal_path


def current_plan(planned: DataFrame) -> DataFrame:
    """One row per (plan_id, ord): the latest record. Rows without these ids are dropped."""
    return latest(planned.where("plan_id is not null and ord is not null"), ["plan_id", "ord"], "recorded_at")


def tier_counts(planned: DataFrame) -> DataFrame:
    """Per session the included units by tier, their tokens, and the skeletons by reason."""
    tier = lambda name: F.count_if(F.lower("inclusion") == name).alias(f"n_{name}")
    positive = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))
    reason = F.regexp_replace(F.lower("skeleton_reason"), "_", "")
    return current_plan(planned).groupBy("session_id").agg(
        F.count("*").alias("items"), tier("full"), tier("compact"), tier("skeleton"), F.sum(positive).alias("tokens"),
        F.count_if(reason == "budgetexhausted").alias("n_exhausted"), F.count_if(reason == "lowrelevance").alias("n_low"),
    )


def compression(planned: DataFrame, units: DataFrame) -> DataFrame:
    """Per session: raw tokens of the planned units in full, tokens used, and the per cent saved (0 if nothing is raw)."""
    used = current_plan(planned).where("unit_id is not null").select("session_id", "unit_id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("tokens"))
    joined = used.join(units.select("unit_id", "tok_full"), "unit_id")
    sums = joined.groupBy("session_id").agg(F.sum(F.coalesce("tok_full", F.lit(0))).alias("raw"), F.sum("tokens").alias("used"))
    return sums.withColumn("saved_pct", F.when(F.col("raw") > 0, F.round((1 - F.col("used") / F.col("raw")) * 100, 4)).otherwise(0.0))


def hot_set(planned: DataFrame, units: DataFrame) -> DataFrame:
    """Per session and unit key ``file::name``: how often it was included, when last, how at that time, and its boost."""
    seen = current_plan(planned).where("unit_id is not null").select("session_id", "unit_id", "inclusion", "recorded_at", "plan_id", "ord")
    keyed = seen.join(units.select("unit_id", F.concat_ws("::", normal_path(F.col("file")), "name").alias("unit_key")), "unit_id")
    order = F.struct(F.col("recorded_at"), F.col("plan_id"), F.col("ord"))
    hot = keyed.groupBy("session_id", "unit_key").agg(F.count("*").alias("accesses"), F.max("recorded_at").alias("last_at"), F.max_by("inclusion", order).alias("last_inclusion"))
    return hot.withColumn("boost", session_boost(F.col("accesses")))


def _scans(cache: DataFrame) -> DataFrame:
    rows = cache.select("repo", normal_path(F.col("relative_path")).alias("path"), "mtime_secs", "mtime_nanos", "file_size", "content_hash", "scanned_at").where("path is not null").distinct()
    order = Window.partitionBy("repo", "path").orderBy("scanned_at", "mtime_secs", "mtime_nanos", "file_size", F.col("content_hash").asc_nulls_first())
    before = lambda c: F.lag(c).over(order)
    return rows.withColumns({"n": F.row_number().over(order), **{f"was_{c}": before(c) for c in ("mtime_secs", "mtime_nanos", "file_size", "content_hash")}})


def scan_reuse(cache: DataFrame) -> DataFrame:
    """Each scan of a file against the one before: new, unchanged (time and size), same_content (hash), or changed.

    The window is over the scans of one file, which are few.
    """
    same = (F.col("mtime_secs") == F.col("was_mtime_secs")) & (F.col("mtime_nanos") == F.col("was_mtime_nanos")) & (F.col("file_size") == F.col("was_file_size"))
    kind = F.when(F.col("n") == 1, "new").when(F.coalesce(same, F.lit(False)), "unchanged").when(F.coalesce(F.col("content_hash") == F.col("was_content_hash"), F.lit(False)), "same_content").otherwise("changed")
    return _scans(cache).select("repo", "path", F.col("n").alias("scan"), kind.alias("reuse"))


def purge(cache: DataFrame, units: DataFrame) -> DataFrame:
    """Cached files that no unit comes from any more."""
    living = units.select("repo", normal_path(F.col("file")).alias("path")).distinct()
    return cache.select("repo", normal_path(F.col("relative_path")).alias("path")).where("path is not null").distinct().join(living, ["repo", "path"], "left_anti")


def recency(events: DataFrame) -> DataFrame:
    """Per user the age boost of the latest event among all users' latest: min(1.5 decay, 3).

    Positions are dense ranks by day, taken from the small table of distinct days.
    """
    last = events.where("user_id is not null and ts is not null").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("day"))
    days = last.select("day").distinct()
    position = days.withColumn("position", F.row_number().over(Window.orderBy(F.desc("day"))) - 1)
    return last.join(F.broadcast(position), "day").select("user_id", "position", F.round(F.least(F.lit(3.0), 1.5 * age_decay(F.col("position"))), 6).alias("boost"))


def shared_callees(edges: DataFrame) -> DataFrame:
    """Per file the number of units of other files that it calls: distinct callees, and calls in all."""
    rows = edges.where("caller_file is not null and callee_id is not null").select("caller_file", "caller_id", "callee_id", "caller_line").distinct()
    return rows.groupBy("caller_file").agg(F.count_distinct("callee_id").alias("callees"), F.count("*").alias("calls"))


def scan_filter(cache: DataFrame) -> DataFrame:
    """Per repository and outcome (ignored, unread, kept): different files and the sum of their greatest sizes.

    A file is ignored by its folders or a minified ending, unread where its ending is of no known language.
    Judged by the path alone, before any content is read; null paths are dropped, null sizes count 0.
    """
    files = cache.select("repo", normal_path(F.col("relative_path")).alias("path"), "file_size").where("path is not null")
    once = files.groupBy("repo", "path").agg(F.coalesce(F.max("file_size"), F.lit(0)).alias("size"))
    known = language_of(F.col("path")).isNotNull()
    outcome = F.when(F.col("path").rlike(IGNORED_PATH), "ignored").when(known, "kept").otherwise("unread")
    return once.groupBy("repo", outcome.alias("outcome")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def file_recency(cache: DataFrame, commits: int = 30) -> DataFrame:
    """``repo, path, recency`` of the files touched by the last ``commits`` changes of a repository, a limit by intent.

    A change is all that a repository's files have of one modification time; the newest counts 1, older ones decay with
    their place. A file touched more than once keeps its greatest value. Null paths and times are dropped.
    """
    touched = cache.select("repo", normal_path(F.col("relative_path")).alias("path"), "mtime_secs").where("path is not null and mtime_secs is not null and repo is not null").distinct()
    times = touched.select("repo", "mtime_secs").distinct()
    last = times.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("mtime_secs"))) - 1).where(F.col("position") < commits)
    return touched.join(last, ["repo", "mtime_secs"]).groupBy("repo", "path").agg(F.max(age_decay(F.col("position"))).alias("recency"))


def recency_of_units(units: DataFrame, recency: DataFrame) -> DataFrame:
    """``unit_id, boost``: min(1.5 recency, 3) of a unit's file, by its path or, where that has none, by a path that ends it.

    For the latter each path asks with its own ends, so both lookups are equal joins; the greatest recency counts.
    """
    paths = units.select("unit_id", "repo", normal_path(F.col("file")).alias("path")).where("path is not null")
    parts = F.split("path", "/")
    ends = paths.select("unit_id", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("end"), "path")
    met = ends.join(recency.withColumnRenamed("path", "end"), ["repo", "end"])
    best = met.groupBy("unit_id").agg(F.max(F.when(F.col("end") == F.col("path"), F.col("recency"))).alias("exact"), F.max("recency").alias("ended"))
    return best.select("unit_id", F.round(F.least(F.lit(3.0), 1.5 * F.coalesce("exact", "ended")), 6).alias("boost"))


def cache_checksum(cache: DataFrame) -> DataFrame:
    """``repo, entries, checksum``: a digest of a repository's manifest that does not depend on the order of its rows.

    Each entry's digest goes into the bucket of its first two hexadecimal digits; the digests of a bucket, in order, make its
    digest, and these the repository's. Nulls stand as empty fields, entries given twice count once.
    """
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entry = F.sha2(F.concat_ws("|", normal_path(F.col("relative_path")), field("mtime_secs"), field("mtime_nanos"), field("file_size"), field("content_hash")), 256)
    entries = cache.where("repo is not null and relative_path is not null").select("repo", entry.alias("digest")).distinct()
    join = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    buckets = entries.groupBy("repo", F.substring("digest", 1, 2).alias("bucket")).agg(F.count("*").alias("n"), join("digest").alias("part"))
    return buckets.groupBy("repo").agg(F.sum("n").alias("entries"), join(F.concat("bucket", "part")).alias("checksum"))


def weak_intent(docs: DataFrame) -> DataFrame:
    """``repo, intent``: what a repository says of itself where no question is asked.

    The first line of its first readme (by doc_id) without heading marks, at most 120 bytes, else the repository's name.
    """
    line = F.trim(F.regexp_replace(F.substring_index(F.ltrim(F.regexp_replace("text", r"^\s+", "")), "\n", 1), "^#+ *", ""))
    told = F.when((F.col("doc_kind") == "readme") & (F.octet_length(line) > 0) & (F.octet_length(line) <= 120), F.struct("doc_id", line.alias("line")))
    return docs.where("repo is not null").groupBy("repo").agg(F.min(told).alias("first")).select("repo", F.coalesce("first.line", "repo").alias("intent"))
