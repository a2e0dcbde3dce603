"""From units and a question to a packed, rendered and redacted context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import graph, packing, ranking, units as code
from quillspan.sources.tables import cut, spread

# The question that the registered queries ask, as terms and weights: its words at 1, near words at 0.75.
QUESTION = {"ledger": 1.0, "budget": 1.0, "rank": 1.0, "session": 1.0, "balanc": 0.75, "quota": 0.75, "score": 0.75}
COLUMNS = ["repo", "file", "kind", "name", "start_line", "end_line", "tok_full", "tok_compact", "tok_skeleton"]
PARTS = ["name_score", "doc_score", "sig_score", "body_score", "matched_terms", "score"]


def scored_units(raw: DataFrame, question: dict[str, float] = QUESTION) -> DataFrame:
    """Current units with score parts and total, without their texts.

    Rows are scored where they are read, and only then is the latest of each unit taken, so that no text is shuffled.
    """
    rows = spread(raw.select("unit_id", *COLUMNS, "doc_comment", "signature", "full_text", "ingested_at"))
    scored = ranking.lexical_scores(rows, question).select("unit_id", *COLUMNS, *PARTS, "ingested_at")
    return code.current_units(scored, [*COLUMNS, *PARTS])


def _narrow(raw: DataFrame, question: dict[str, float]) -> DataFrame:
    columns = ("unit_id", "file", "name", "start_line", "score", "tok_full", "tok_compact", "tok_skeleton")
    return scored_units(raw, question).where("repo is not null").select(F.col("repo").alias("grp"), *columns)


def packed(raw: DataFrame, budget: int = 4000, question: dict[str, float] = QUESTION) -> DataFrame:
    """Every repository's units packed into the budget; texts stay out of packing."""
    return packing.pack(_narrow(raw, question), budget)


def with_dependencies(raw: DataFrame, edges: DataFrame, budget: int = 4000, question: dict[str, float] = QUESTION) -> DataFrame:
    """Pack, add 2.5 to the score of what the full units call, and pack once more."""
    narrow = cut(_narrow(raw, question))
    first = packing.pack(narrow, budget).where("inclusion = 'full'")
    pulled = graph.dependencies(edges, first).withColumn("pulled", F.lit(2.5))
    boosted = narrow.join(pulled, "unit_id", "left").withColumn("score", F.round(F.col("score") + F.coalesce("pulled", F.lit(0.0)), 6)).drop("pulled")
    return packing.pack(boosted, budget)


def payloads(raw: DataFrame, budget: int = 4000) -> DataFrame:
    """The rendered payload of each file that the packing keeps."""
    narrow = cut(_narrow(raw, QUESTION))
    plan = cut(packing.pack(narrow, budget).where("inclusion is not null").select("grp", "unit_id", "inclusion").join(narrow.select("unit_id", "score"), "unit_id"))
    # Only the texts of what the plan holds are shuffled.
    held = raw.join(plan.select("unit_id"), "unit_id", "left_semi")
    texts = code.current_units(held, ["file", "start_line", "end_line", "full_text", "compact_text", "skeleton_text"])
    return packing.render(plan.join(texts, "unit_id"))


def explained(raw: DataFrame, edges: DataFrame, budget: int = 4000) -> DataFrame:
    """For every unit of a repository its score parts, centrality, matched terms, tier, tokens and reason, and its place by score."""
    scored = cut(scored_units(raw))
    plan = packed(raw, budget).select("grp", "unit_id", "inclusion", "tokens", "skeleton_reason")
    central = graph.pagerank(raw.select("unit_id").where("unit_id is not null"), edges)
    order = Window.partitionBy("grp").orderBy(F.desc("lexical"), "file", F.coalesce("start_line", F.lit(0)), "name", "unit_id")
    joined = plan.join(scored.withColumnRenamed("score", "lexical").withColumn("matched", F.array_join("matched_terms", ",")), "unit_id").join(central, "unit_id", "left")
    parts = [F.round(c, 6).alias(c) for c in PARTS[:4]]
    return joined.select("grp", "unit_id", "lexical", *parts, F.coalesce("centrality", F.lit(0.0)).alias("centrality"), "matched", F.coalesce("inclusion", F.lit("left_out")).alias("tier"), "tokens", "skeleton_reason", F.row_number().over(order).alias("place"))
