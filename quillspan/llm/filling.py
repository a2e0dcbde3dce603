"""Filling containers of fixed capacity with items of varying length.

A session is solved on its histogram, how many items it has of each length, which its capacity bounds however many items it
has. Shallow combinations of lengths that fill a window just below the capacity (or below an equal part of it, where items are
small) are priced by what of the histogram is still uncovered; non-negative least squares gives how often each should be
used, the counts are rounded down, and the residue is packed greedily, each container around its longest item by the sum of
others that comes nearest to the capacity. Spark counts, ranks the items of each length, and deals the containers back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.sources.tables import latest

FINEST = 1 << 16  # a capacity is divided into at most so many steps; lengths are rounded up to them
DEALT = 4096
BUCKET = 20_000
_SEGMENTS = "session_id string, tokens long, first long, n long, base long, per long"


def nonnegative_counts(combos: np.ndarray, histogram: np.ndarray, start: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """x >= 0 with ``combos.T @ x`` closest to ``histogram``: projected gradient with momentum, from ``start`` on."""
    x = np.zeros(len(combos))
    if start is not None:
        x[: len(start)] = start
    scale = np.abs(combos).sum(1)
    pace = 1.0 / max(1e-9, float((combos.T @ scale).max()))  # the squared norm is at most the greatest of |A'||A|1
    ahead, speed = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, ahead - pace * (combos @ (ahead @ combos - histogram)))
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead = new + (speed - 1) / faster * (new - x)
        done = np.abs(new - x).max() < 1e-3
        x, speed = new, faster
        if done:
            break
    return x


class _Combinations:
    """All combinations of up to three lengths, and of four equal ones, that fill the window, by their longest length.

    For each pair the third length is the longest one that fits; ``lengths`` ascend. Rows of the tables are worked off in
    slices, so that no more than about a million pairs are held at a time.
    """

    def __init__(self, lengths: np.ndarray, capacity: int, low: float):
        self.lengths, self.capacity, self.low = lengths, capacity, low
        self.slice = max(1, 1_000_000 // max(1, len(lengths)))
        self.kept = self._table(0, len(lengths)) if len(lengths) <= self.slice else None

    def _table(self, low: int, high: int):
        x = self.lengths
        room = self.capacity - x[low:high, None] - x[None, :high]
        pair = (np.arange(high)[None] <= np.arange(low, high)[:, None]) & (room >= 0)
        third = np.minimum(np.searchsorted(x, np.maximum(room, 0), "right") - 1, np.arange(high)[None])
        slack = self.capacity - self.low
        two = pair & (room <= slack)
        three = pair & (third >= 0) & (room - x[np.maximum(third, 0)] <= slack)
        return two, three, np.maximum(third, 0)

    def dearest(self, price: np.ndarray) -> list[tuple[int, ...]]:
        """For each longest length the combination that covers most of what has a price."""
        x, found = self.lengths, []
        for low in range(0, len(x), self.slice):
            high = min(len(x), low + self.slice)
            two, three, third = self.kept if self.kept is not None else self._table(low, high)
            of = price[:high]
            pairs, triples = np.where(two, of[None], -np.inf), np.where(three, of[None] + of[third], -np.inf)
            b2, b3 = pairs.argmax(1), triples.argmax(1)
            rows = np.arange(high - low)
            own = of[low:high]
            worth = np.stack([np.where(x[low:high] >= self.low, own, -np.inf), own + pairs[rows, b2], own + triples[rows, b3], np.where((4 * x[low:high] >= self.low) & (4 * x[low:high] <= self.capacity), 4 * own, -np.inf)])
            kind = worth.argmax(0)
            for r in np.flatnonzero((worth.max(0) > 0.5) & (own > 0)).tolist():
                a = low + r
                found.append([(a,), (a, int(b2[r])), (a, int(b3[r]), int(third[r, b3[r]])), (a, a, a, a)][kind[r]])
        return found


def by_combinations(lengths: np.ndarray, counts: np.ndarray, capacity: int, window: float = 0.005, rounds: int = 4) -> list[tuple[int, np.ndarray]]:
    """(times, items of each length) of the containers that rounded least squares fills; ``lengths`` ascend.

    Combinations are generated as columns: those that cover most of the residue of the last solution come in. Where items
    are small, combinations fill an equal part of the container, and so many of them one container.
    """
    mean = float((lengths * counts).sum() / counts.sum())
    parts = max(1, round(capacity / (3 * mean)))
    part = capacity // parts
    size = int(np.searchsorted(lengths, part, "right"))
    if not size:
        return []
    held = counts[:size].astype(float)
    combos = _Combinations(lengths[:size], part, part * (1 - window))
    columns: dict[tuple[int, ...], None] = {}
    table, times = np.zeros((0, size)), np.zeros(0)
    for _ in range(rounds):
        fresh = [c for c in combos.dearest(held - times @ table) if c not in columns]
        if not fresh:
            break
        columns |= dict.fromkeys(fresh)
        more = np.zeros((len(fresh), size))
        for j, c in enumerate(fresh):
            for k in c:
                more[j, k] += 1
        table = np.concatenate((table, more))
        times = nonnegative_counts(table, held, times)
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[int, np.ndarray]] = []
    need_of = np.zeros((len(table), len(lengths)), np.int64)
    need_of[:, :size] = table
    for j in np.argsort(-times, kind="stable")[: int((times >= 0.95).sum())]:
        need = need_of[j]
        on = need > 0
        n = min(int(times[j] + 0.05), int((left[on] // need[on]).min()))
        if n > 0:
            left -= n * need
            chosen.append((n, need))
    if parts == 1:
        return chosen
    # Combinations in a row make up containers; the last few that make none go back to the residue.
    out, open_parts, have = [], np.zeros(len(lengths), np.int64), 0
    for n, need in chosen:
        while n:
            if not have and n >= parts:
                out.append((n // parts, need * parts))
                n %= parts
                continue
            take = min(n, parts - have)
            open_parts, have, n = open_parts + take * need, have + take, n - take
            if have == parts:
                out.append((1, open_parts))
                open_parts, have = np.zeros(len(lengths), np.int64), 0
    return out


def _around(lengths: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each length (descending, the first one present) fill a container best around one of the first."""
    m, room = len(lengths), capacity - lengths[0]
    mask, sums = (1 << (room + 1)) - 1, [1] * (m + 1)
    for k in range(m - 1, -1, -1):
        reach, length = sums[k + 1], lengths[k]
        free, step = min(counts[k] - (k == 0), room // length), 1
        while free > 0:
            take = min(step, free)
            reach |= (reach << (length * take)) & mask
            free, step = free - take, step * 2
        sums[k] = reach
    need, total = [0] * m, sums[0].bit_length() - 1
    for k in range(m):
        length, most = lengths[k], counts[k] - (k == 0)
        # As many as can be while what is left is a sum of the shorter ones.
        for q in range(min(most, total // length), -1, -1):
            if sums[k + 1] >> (total - q * length) & 1:
                need[k], total = q, total - q * length
                break
    need[0] += 1
    return need


def pack(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, items of each length) of the containers for a histogram; ``lengths`` ascend, are positive and at most ``capacity``.

    Every item has its place, no container exceeds the capacity.
    """
    if capacity > FINEST:
        unit = -(-capacity // FINEST)
        lengths, capacity = -(-lengths // unit), capacity // unit
        lengths = np.minimum(lengths, capacity)
    plan = by_combinations(lengths, counts, capacity)
    left = counts.astype(np.int64).copy()
    for times, need in plan:
        left -= times * need
    order = [int(k) for k in np.argsort(-lengths, kind="stable") if left[k]]
    while order:
        need = _around([int(lengths[k]) for k in order], [int(left[k]) for k in order], capacity)
        times = min(int(left[k]) // q for k, q in zip(order, need) if q)
        whole = np.zeros(len(lengths), np.int64)
        whole[order] = need
        plan.append((times, whole))
        left -= times * whole
        order = [k for k in order if left[k]]
    return plan


def items_of(planned: DataFrame, plans: DataFrame) -> DataFrame:
    """The items to pack: one per (plan_id, ord), the latest record; only positive lengths; too long ones in pieces.

    Items of sessions without a positive budget, or with a null session, plan or ord, take no part.
    """
    budgets = plans.where("budget_tokens > 0 and session_id is not null").groupBy("session_id").agg(F.max("budget_tokens").alias("capacity"))
    named = planned.select("plan_id", "ord", "session_id", "tokens", "recorded_at").where("plan_id is not null and ord is not null")
    once = latest(named, ["plan_id", "ord"], "recorded_at").where("tokens > 0 and session_id is not null")
    whole = once.join(budgets, "session_id")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))))
    return pieces.withColumn("tokens", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity"))).select("session_id", "plan_id", "ord", "piece", "tokens", "capacity")


def _plans(batches):
    """The containers of each session's histogram, as runs of items of one length: ``per`` of them in each container from ``base``.

    The histograms of a partition come in a row, each session's at once; the last of a batch may go on in the next one.
    """
    columns = ["session_id", "tokens", "first", "n", "base", "per"]
    begun: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if begun is None else pd.concat([begun, pdf], ignore_index=True)
        names = pdf["session_id"].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(pdf) else np.zeros(0, int)
        if not len(edges):
            continue
        yield pd.DataFrame([r for a, b in zip(edges, edges[1:]) for r in _runs(pdf, a, b)], columns=columns)
        begun = pdf.iloc[edges[-1] :]
    if begun is not None:
        yield pd.DataFrame(list(_runs(begun.reset_index(drop=True), 0, len(begun))), columns=columns)


def _runs(pdf: pd.DataFrame, low: int, high: int):
    name, capacity = pdf["session_id"].iat[low], int(pdf["capacity"].iat[low])
    lengths, counts = pdf["tokens"].to_numpy()[low:high], pdf["n"].to_numpy()[low:high]
    used, base = np.zeros(len(lengths), np.int64), 0
    for times, need in pack(lengths, counts, capacity):
        for k in np.flatnonzero(need).tolist():
            per = int(need[k])
            step = max(1, DEALT // per)
            for begin in range(0, times, step):
                n = min(step, times - begin) * per
                yield name, int(lengths[k]), int(used[k]), n, base + begin, per
                used[k] += n
        base += times


def fill_containers(planned: DataFrame, plans: DataFrame) -> DataFrame:
    """``session_id, plan_id, ord, piece, tokens, capacity, container``: every item or piece once, no container over capacity.

    A task solves one session's histogram, at most a row per length. Items of one length are alike, so any of them may take
    any of its places: they are numbered within buckets of bounded size and joined to the places by their number.
    """
    items = items_of(planned, plans)
    length = ["session_id", "tokens"]
    buckets = items.groupBy(*length).agg(F.count("*").alias("n"), F.max("capacity").alias("capacity"))
    # Solving is heavy for its few bytes, so the number of partitions is set here rather than by their size.
    spark = items.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    sorted_by = buckets.select("session_id", "tokens", "n", "capacity").repartition(parts, "session_id").sortWithinPartitions("session_id", "tokens")
    segments = sorted_by.mapInPandas(_plans, _SEGMENTS)
    places = segments.repartition(parts).select("session_id", "tokens", "first", "base", "per", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i")).select(
        "session_id", "tokens", (F.col("first") + F.col("i")).alias("number"), (F.col("base") + F.floor(F.col("i") / F.col("per"))).cast("long").alias("container")
    )
    dealt = items.join(buckets.select(*length, F.ceil(F.col("n") / BUCKET).alias("buckets")), length)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("plan_id", "ord", "piece"), F.col("buckets"))).drop("buckets")
    sizes = dealt.groupBy(*length, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*length).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*length, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy(*length, "bucket").orderBy("plan_id", "ord", "piece")
    numbered = dealt.withColumn("inner", F.row_number().over(inner) - 1).join(offsets, [*length, "bucket"]).withColumn("number", F.col("offset") + F.col("inner"))
    return numbered.join(places, [*length, "number"]).select("session_id", "plan_id", "ord", "piece", "tokens", "capacity", "container")


def compare_fill(arranged: DataFrame, plans: DataFrame) -> DataFrame:
    """Per session: containers, tokens and fill of the arrangement beside the recorded plans and their used_tokens.

    Recorded plans are taken once by plan_id, the latest; null used_tokens count as 0 there.
    """
    ours = (
        arranged.groupBy("session_id", "container").agg(F.sum("tokens").alias("used"), F.max("capacity").alias("capacity"))
        .groupBy("session_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("capacity").alias("budget_tokens"), F.max("used").alias("fullest"))
    )
    once = latest(plans.select("plan_id", "session_id", "used_tokens", "created_at").where("plan_id is not null"), ["plan_id"], "created_at")
    recorded = once.groupBy("session_id").agg(F.count("*").alias("recorded_plans"), F.sum(F.coalesce("used_tokens", F.lit(0))).alias("recorded_tokens"))
    fill = lambda used, count: F.round(F.col(used) / (F.col(count) * F.col("budget_tokens")), 6)
    return ours.join(recorded, "session_id", "left").select(
        "session_id", "budget_tokens", "containers", F.ceil(F.col("tokens") / F.col("budget_tokens")).alias("least_possible"), "tokens", "fullest", fill("tokens", "containers").alias("fill"), "recorded_plans", fill("recorded_tokens", "recorded_plans").alias("recorded_fill")
    )
