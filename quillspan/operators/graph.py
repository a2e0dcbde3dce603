"""The call graph of units: resolving calls, degrees, centrality and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.sources.tables import cut


BLOCK = 1024


def _definitions(units: DataFrame) -> DataFrame:
    stem = F.lower(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1))
    return units.where("name is not null and name <> '' and name <> '<anonymous>'").select("repo", "name", F.col("unit_id").alias("callee_id"), F.col("file").alias("callee_file"), stem.alias("stem"))


def _all_namesakes(asks: DataFrame, defs: DataFrame) -> DataFrame:
    """``asks`` (repo, name, ...) with each other unit of the name in the repository, which is the result asked for.

    The definitions of one name are dealt into blocks of bounded size and each ask goes to every block, so that a name that
    very many units bear is no single task.
    """
    sizes = defs.groupBy("repo", "name").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = defs.join(sizes, ["repo", "name"]).select("repo", "name", "callee_id", F.pmod(F.xxhash64("callee_id"), F.col("blocks")).cast("int").alias("block"))
    asked = asks.join(sizes, ["repo", "name"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return asked.join(held, ["repo", "name", "block"]).where("unit_id <> callee_id").select("unit_id", "callee_id", "name", "line")


def call_edges(units: DataFrame) -> DataFrame:
    """Distinct edges caller_id, callee_id, callee_name, line from the calls of units.

    Per call, within the caller's repository: a unit of that name in a file whose stem is the call's qualifier (any case),
    the first by id, and no edge if that is the caller itself; else the first other one of the same file; else all other
    units of the name. Anonymous names never match. The first two are looked up among definitions with one row per key.
    """
    calls = units.select("unit_id", "repo", "file", F.explode("calls").alias("call")).select(
        "repo", "unit_id", "file", F.col("call.callee").alias("name"), F.lower("call.qualifier").alias("stem"), F.col("call.line").alias("line")
    ).distinct()
    defs = _definitions(units)
    by_stem = defs.groupBy("repo", "name", "stem").agg(F.min("callee_id").alias("stem_id"))
    # Of a file's units of one name the two least are enough: one of them is not the caller.
    by_file = defs.groupBy("repo", "name", F.col("callee_file").alias("file")).agg(F.min("callee_id").alias("low"), F.max("callee_id").alias("top"))
    second = defs.join(by_file.where("low < top").select("repo", "name", F.col("file").alias("callee_file"), "low"), ["repo", "name", "callee_file"]).where("callee_id > low").groupBy("repo", "name", F.col("callee_file").alias("file")).agg(F.min("callee_id").alias("next"))
    met = calls.join(by_stem, ["repo", "name", "stem"], "left").join(by_file.drop("top"), ["repo", "name", "file"], "left").join(second, ["repo", "name", "file"], "left")
    same = F.when(F.col("low") != F.col("unit_id"), F.col("low")).otherwise(F.col("next"))
    told = met.withColumns({"single": F.coalesce("stem_id", same)})
    single = told.where("single is not null and single <> unit_id").select("unit_id", F.col("single").alias("callee_id"), "name", "line")
    wide = _all_namesakes(told.where("single is null").select("repo", "name", "unit_id", "line"), defs)
    return single.union(wide).select(F.col("unit_id").alias("caller_id"), "callee_id", F.col("name").alias("callee_name"), "line").distinct()


def reference_edges(units: DataFrame) -> DataFrame:
    """Edges of units without calls, from the names they refer to: all other units of each name, at the caller's first line.

    Nulls in refs, lines or repositories make no edge but for a null line, which stays null.
    """
    quiet = units.where("calls is null or size(calls) = 0").select("repo", "unit_id", F.explode("refs").alias("name"), F.col("start_line").alias("line")).distinct()
    found = _all_namesakes(quiet, _definitions(units))
    return found.select(F.col("unit_id").alias("caller_id"), "callee_id", F.col("name").alias("callee_name"), "line").distinct()


def all_edges(units: DataFrame) -> DataFrame:
    """The edges of calls, and those of references where a unit has no calls; a unit has edges of one kind only."""
    return call_edges(units).union(reference_edges(units))


def neighbours(edges: DataFrame) -> DataFrame:
    """Per unit with any: its callees and its callers, distinct and sorted, as lists; their number bounds each list."""
    links = distinct_links(edges)
    out = links.groupBy(F.col("caller_id").alias("unit_id")).agg(F.array_sort(F.collect_set("callee_id")).alias("callees"))
    into = links.groupBy(F.col("callee_id").alias("unit_id")).agg(F.array_sort(F.collect_set("caller_id")).alias("callers"))
    none = F.array().cast("array<bigint>")
    return out.join(into, "unit_id", "full").select("unit_id", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))


def distinct_links(edges: DataFrame) -> DataFrame:
    """Distinct (caller_id, callee_id); nulls and loops are no links."""
    return edges.where("caller_id is not null and callee_id is not null and caller_id <> callee_id").select("caller_id", "callee_id").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Per unit the number of different callees and callers, 0 where none."""
    links = distinct_links(edges)
    out = links.groupBy(F.col("caller_id").alias("unit_id")).agg(F.count("*").alias("callees"))
    into = links.groupBy(F.col("callee_id").alias("unit_id")).agg(F.count("*").alias("callers"))
    return out.join(into, "unit_id", "full").select("unit_id", F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("callers", F.lit(0)).alias("callers"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """``unit_id, centrality``: votes along calls, divided by the out-degree, no redistribution of dangling ranks.

    Ranks are divided by the greatest (1e-6 at least). Lineage is cut every few rounds by a checkpoint
    in the shared folder. A node that a third of all edges meet only adds up partial sums.
    """
    ids = nodes.select("unit_id").distinct()
    count = ids.count()
    if count == 0:
        return ids.withColumn("centrality", F.lit(0.0))
    links = distinct_links(edges).join(ids.withColumnRenamed("unit_id", "caller_id"), "caller_id", "left_semi").join(ids.withColumnRenamed("unit_id", "callee_id"), "callee_id", "left_semi")
    out = links.groupBy("caller_id").agg(F.count("*").alias("degree"))
    links = cut(links.join(out, "caller_id"))
    ranks = ids.withColumn("rank", F.lit(1.0 / count))
    for step in range(1, rounds + 1):
        votes = links.join(ranks.withColumnRenamed("unit_id", "caller_id"), "caller_id").groupBy(F.col("callee_id").alias("unit_id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("votes"))
        ranks = ids.join(votes, "unit_id", "left").select("unit_id", ((1 - damping) / count + damping * F.coalesce("votes", F.lit(0.0))).alias("rank"))
        if step % every == 0 and step < rounds:
            ranks = cut(ranks)
    ranks = cut(ranks)
    top = ranks.agg(F.greatest(F.max("rank"), F.lit(1e-6)).alias("top"))
    return ranks.join(F.broadcast(top)).select("unit_id", F.round(F.least(F.lit(1.0), F.col("rank") / F.col("top")), 6).alias("centrality"))


def dependencies(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct callees of the chosen units that are not chosen themselves."""
    ids = chosen.select("unit_id").distinct()
    pulled = distinct_links(edges).join(ids.withColumnRenamed("unit_id", "caller_id"), "caller_id", "left_semi").select(F.col("callee_id").alias("unit_id")).distinct()
    return pulled.join(ids, "unit_id", "left_anti")


def edge_reasons(edges: DataFrame, full: DataFrame) -> DataFrame:
    """For each callee of the full units its first caller: callee_id, caller_id, caller_file, caller_line, callers.

    First is the least (caller_id, caller_file, caller_line), nulls first; edges given twice count once. Kept by partial
    minima, so a callee that everything calls is no single task.
    """
    rows = edges.select("caller_id", "callee_id", "caller_file", "caller_line").where("caller_id is not null and callee_id is not null and caller_id <> callee_id")
    met = rows.join(full.select(F.col("unit_id").alias("caller_id")).distinct(), "caller_id", "left_semi")
    first = F.min(F.struct("caller_id", "caller_file", "caller_line")).alias("first")
    told = met.distinct().groupBy("callee_id").agg(first, F.count("*").alias("calls"))
    return told.select("callee_id", "first.*", "calls")
