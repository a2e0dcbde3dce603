"""Packing units into a token budget at three levels of detail."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.sources.tables import cut

HEAD = 4096
_SCHEMA = "grp string, unit_id long, ord int, inclusion string, tokens long, skeleton_reason string, warned boolean, used long"


def _fold(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Admit the units of one head in order; ``used`` continues from earlier heads."""
    rows, used = [], int(pdf["used"].iloc[0])
    share = budget * 60 // 100
    for r in pdf.sort_values("ord").itertuples():
        full, compact, skeleton = int(r.tok_full), int(r.tok_compact), int(r.tok_skeleton)
        if used + skeleton > budget:
            rows.append((r.grp, r.unit_id, r.ord, None, 0, None, False))
            continue
        used += skeleton
        kind, tokens, reason = "skeleton", skeleton, "low_relevance"
        if r.candidate:
            reason = None
            greedy = r.n > 1 and full > share and used + (full - skeleton) + (r.n - 1) * 15 > budget
            if full <= skeleton:
                kind, tokens = "full", full
            elif not greedy and used + full - skeleton <= budget:
                kind, tokens, used = "full", full, used + full - skeleton
            elif compact > skeleton and used + compact - skeleton <= budget:
                kind, tokens, used = "compact", compact, used + compact - skeleton
            else:
                reason = "budget_exhausted"
        rows.append((r.grp, r.unit_id, r.ord, kind, tokens, reason, bool(r.candidate) and tokens > share))
    out = pd.DataFrame(rows, columns=["grp", "unit_id", "ord", "inclusion", "tokens", "skeleton_reason", "warned"])
    out["used"] = used
    return out


def _upgrade(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Give what is left to skeletons of low relevance, in order; the group's ``used`` goes on from earlier heads."""
    used, rows = int(pdf["used"].iloc[0]), []
    for r in pdf.sort_values("ord").itertuples():
        more = int(r.tok_compact) - int(r.tokens)
        raised = used + more <= budget
        used += more if raised else 0
        rows.append((r.grp, r.unit_id, raised))
    out = pd.DataFrame(rows, columns=["grp", "unit_id", "raised"])
    out["used"] = used
    return out


def packing_order(units: DataFrame) -> DataFrame:
    """Candidates (score > 0, or all where none is) before others; by score, or by turns of files where no score is positive.

    Adds candidate, turn, rank and ``n``, the candidates of the group; one aggregate gives all a group needs.
    """
    score = F.coalesce("score", F.lit(0.0))
    groups = units.groupBy("grp").agg(F.count_if(score > 0).alias("positive"), F.count("*").alias("all"))
    ready = units.join(groups, "grp").withColumn("any", F.col("positive") > 0)
    turn = F.row_number().over(Window.partitionBy("grp", "file").orderBy("unit_id"))
    return ready.withColumns({
        "candidate": ~F.col("any") | (score > 0),
        "n": F.when(F.col("any"), F.col("positive")).otherwise(F.col("all")),
        "turn": F.when(F.col("any"), 0).otherwise(turn),
        "rank": F.when(F.col("any"), -score).otherwise(0.0),
    }).drop("any", "positive", "all")


_PLACE = ["candidate", "turn", "rank", "file", "start_line", "name"]
_TOLD = ["inclusion", "tokens", "skeleton_reason", "warned"]


def pack(units: DataFrame, budget: int) -> DataFrame:
    """One row per unit and group ``grp``: ord, inclusion (null: left out), tokens, skeleton_reason, warned.

    ``units`` has grp, unit_id, file, start_line, name, score and the three token counts; nulls in these count as 0 or sort
    first, and equal rows count once. The greedy order is sequential, so a group is admitted head by head: the first
    ``HEAD`` units of each group are taken by a limited window, folded, and of the rest only those that the budget left can
    still change come up again. Units that cost nothing are settled beforehand, whatever their number. So a group of any
    size passes through tasks of at most ``HEAD`` narrow rows, and the rounds end as the budget fills. ``ord`` is a unit's
    place in the packing order where it was folded, null where it was settled without.
    """
    counts = ("tok_full", "tok_compact", "tok_skeleton")
    filled = units.select("grp", "unit_id", "file", "name", F.coalesce("start_line", F.lit(0)).alias("start_line"), "score", *[F.greatest(F.lit(0), F.coalesce(c, F.lit(0))).alias(c) for c in counts]).dropDuplicates(["grp", "unit_id"])
    # The scores behind ``units`` are dear and read twice in ordering, so the narrow rows are written first.
    ordered = cut(packing_order(cut(filled)))
    free = (F.col("tok_skeleton") == 0) & (~F.col("candidate") | (F.col("tok_full") <= 0))
    settled = ordered.where(free).select("grp", "unit_id", F.lit(None).cast("int").alias("ord"), F.when(F.col("candidate"), "full").otherwise("skeleton").alias("inclusion"), F.lit(0).cast("long").alias("tokens"), F.when(~F.col("candidate"), "low_relevance").alias("skeleton_reason"), F.lit(False).alias("warned"))
    used, final, parts = None, None, [settled]
    waiting, passed = ordered.where(~free), 0
    while not waiting.isEmpty():
        head = waiting.withColumn("ord", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("candidate"), *_PLACE[1:], "unit_id"))).where(F.col("ord") <= HEAD)
        head = head.withColumn("used", F.lit(0).cast("long")) if used is None else head.join(used, "grp")
        head = head.withColumn("ord", F.col("ord") + passed)
        told = cut(head.groupBy("grp").applyInPandas(lambda pdf: _fold(pdf, budget), _SCHEMA))
        parts.append(told.select("grp", "unit_id", "ord", *_TOLD))
        used = told.groupBy("grp").agg(F.max("used").alias("used"))
        final = told.select("grp", "used") if final is None else final.union(told.select("grp", "used"))
        rest = waiting.join(told, ["grp", "unit_id"], "left_anti").join(used, "grp")
        fits = lambda c: F.col("used") + F.col(c) <= budget
        bare = (F.col("tok_skeleton") == 0) & ~fits("tok_full") & ~((F.col("tok_compact") > 0) & fits("tok_compact"))
        done = ~fits("tok_skeleton") | bare
        parts.append(rest.where(done).select("grp", "unit_id", F.lit(None).cast("int").alias("ord"), F.when(fits("tok_skeleton"), "skeleton").alias("inclusion"), F.lit(0).cast("long").alias("tokens"), F.when(fits("tok_skeleton"), "budget_exhausted").alias("skeleton_reason"), F.lit(False).alias("warned")))
        waiting, passed = rest.where(~done).drop("used"), passed + HEAD
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    used = None if final is None else final.groupBy("grp").agg(F.max("used").alias("used"))  # of groups that ended early too
    raised = _raised(ordered, every, used, budget)
    if raised is None:
        return every
    up = raised.where("raised").select("grp", "unit_id", F.lit(True).alias("up")).join(ordered.select("grp", "unit_id", "tok_compact"), ["grp", "unit_id"])
    joined = every.join(up, ["grp", "unit_id"], "left")
    return joined.select("grp", "unit_id", "ord", F.when(F.col("up"), "compact").otherwise(F.col("inclusion")).alias("inclusion"), F.when(F.col("up"), F.col("tok_compact")).otherwise(F.col("tokens")).alias("tokens"), F.when(F.col("up").isNull(), F.col("skeleton_reason")).alias("skeleton_reason"), "warned")


def _raised(ordered: DataFrame, every: DataFrame, used: DataFrame | None, budget: int) -> DataFrame | None:
    """Which skeletons of low relevance the budget left can raise to compact, head by head in packing order; None if none."""
    low = every.where("skeleton_reason = 'low_relevance'").select("grp", "unit_id", "tokens").join(ordered.select("grp", "unit_id", *_PLACE, "tok_compact"), ["grp", "unit_id"]).where("tok_compact > tokens")
    parts = None
    while True:
        low = low.withColumn("used", F.lit(0).cast("long")) if used is None else low.join(used, "grp", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        low = low.where(F.col("used") + F.col("tok_compact") - F.col("tokens") <= budget)
        head = low.withColumn("ord", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("candidate"), *_PLACE[1:], "unit_id"))).where(F.col("ord") <= HEAD)
        told = cut(head.select("grp", "unit_id", "tokens", "tok_compact", "used", "ord").groupBy("grp").applyInPandas(lambda pdf: _upgrade(pdf, budget), "grp string, unit_id long, raised boolean, used long"))
        if told.isEmpty():
            return parts
        parts = told if parts is None else parts.union(told)
        before = told.groupBy("grp").agg(F.max("used").alias("used"))
        used = before if used is None else used.withColumnRenamed("used", "was").join(before, "grp", "full").select("grp", F.greatest("was", "used").alias("used"))
        low = low.drop("used").join(told, ["grp", "unit_id"], "left_anti")


def suppress_enclosed(included: DataFrame) -> DataFrame:
    """Included units without those inside another included full unit of the same file; of equal ranges the least id stays.

    In the order of first lines, longer ranges first, a unit lies inside another one if a full unit before it reaches as far
    as it does: one running maximum per file. Units with a null file or line suppress nothing and stay.
    """
    order = Window.partitionBy("grp", "file").orderBy("start_line", F.desc("end_line"), F.col("inclusion") != "full", "unit_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = F.col("file").isNotNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    reach = F.max(F.when(placed & (F.col("inclusion") == "full"), F.col("end_line"))).over(order)
    return included.withColumn("_inside", F.coalesce(placed & (reach >= F.col("end_line")), F.lit(False))).where("not _inside").drop("_inside")


def render(included: DataFrame) -> DataFrame:
    """The payload of each file: its heading, then the texts of its units by start line, each followed by a blank line.

    Texts are gathered per file, which a file's own length bounds; files are then ordered by
    (best score, file) without gathering a whole group.
    """
    kept = suppress_enclosed(included)
    text = F.when(F.col("inclusion") == "full", F.col("full_text")).when(F.col("inclusion") == "compact", F.col("compact_text")).otherwise(F.col("skeleton_text"))
    rows = kept.select("grp", "file", "score", F.struct(F.coalesce("start_line", F.lit(0)).alias("start_line"), "unit_id", F.coalesce(text, F.lit("")).alias("text")).alias("part"))
    files = rows.groupBy("grp", "file").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"), F.array_sort(F.collect_list("part")).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: F.concat(p["text"], F.lit("\n\n"))), "")
    return files.select("grp", "file", "best", F.concat(F.lit("// === "), F.col("file"), F.lit(" ===\n"), body).alias("payload"))
