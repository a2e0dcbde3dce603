"""Long spans that stand verbatim in more than one record.

Every window of ``WINDOW`` code points of every text gets a Rabin-Karp hash; of each ``GAP``
neighbouring windows the one with the least hash is kept, so that two texts with ``least`` equal
code points in common always keep one equal window of that stretch. Kept windows are counted in
Spark by hash, and only those in two files or more go on.

A hash of few records is joined with itself; each pair of places names a diagonal of two texts, on
which all maximal intervals of ``least`` equal code points or more are read. A hash of many records (boilerplate) would give pairs in the square of its
records that mostly share too little; there each window is split further, by the hashes of all
windows of the full ``least`` code points around it, until equal hashes are equal spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.sources.tables import cut as cut_lineage

GAP = 64
BLOCK = 1024
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(text: str, size: int) -> np.ndarray:
    """The hash of each window of ``size`` code points, by its start; empty for shorter texts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(codes))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(codes + np.uint64(77)) * up)))
    return _mixed((sums[size:] - sums[:-size]) * down[: len(codes) - size + 1])


def _slide(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` over each ``size`` neighbours (a power of two), by doubling."""
    step = 1
    while step < size:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def kept_windows(text: str, size: int, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that are the least of some ``gap`` neighbours; thinned where equal ones stand in a row."""
    hashes = window_hashes(text, size)
    if len(hashes) < gap:
        return np.zeros(0, np.int64), hashes[:0]
    least = _slide(hashes, gap, np.minimum)
    padded = np.concatenate((np.zeros(gap - 1, np.uint64), least, np.zeros(gap - 1, np.uint64)))
    kept = _slide(padded, gap, np.maximum) == hashes
    # Of equal windows in a row (one character over and over) the first, the last and every ``size``-th are enough.
    fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    if not fresh.all():
        first = np.flatnonzero(fresh)
        inner = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
        kept &= (inner % size == 0) | np.append(fresh[1:], True)
    at = np.flatnonzero(kept)
    return at, hashes[at]


def _texts(units: DataFrame, least: int) -> DataFrame:
    long = units.where(F.col("unit_id").isNotNull() & (F.length("full_text") >= least))  # no pair can name a unit without id
    place = F.xxhash64("repo", F.col("repo").isNull(), "file")  # a hash passes over nulls, so which one is null is told
    return long.select("unit_id", place.alias("place"), F.col("full_text").alias("text"))


def _windows(texts: DataFrame, least: int) -> DataFrame:
    size = least - GAP + 1

    def cut(batches):
        for pdf in batches:
            units, places, starts, hashes = [], [], [], []
            for unit, place, text in zip(pdf["unit_id"], pdf["place"], pdf["text"]):
                at, value = kept_windows(text, size)
                units.append(np.full(len(at), unit))
                places.append(np.full(len(at), place))
                starts.append(at)
                hashes.append(value)
            if units:
                yield pd.DataFrame({"hash": np.concatenate(hashes).view(np.int64), "unit_id": np.concatenate(units), "place": np.concatenate(places), "start": np.concatenate(starts)})

    return texts.mapInPandas(cut, "hash long, unit_id long, place long, start int")


def _repeated(windows: DataFrame) -> DataFrame:
    """Hashes found in two files or more, with their number of places and a sign of which units hold them, and how often."""
    counted = windows.groupBy("hash").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("unit_id", "place").cast("decimal(20,0)")).alias("sign")
    )
    return counted.where("low <> high").select("hash", "n", "sign")


def _pairs_of(held: DataFrame, alike: bool) -> DataFrame:
    """Pairs of places with an equal hash.

    ``alike`` says that equal hashes are results already; then a window held by the very units that
    hold the one before it brings no new pair and does not ask.
    """
    asks = held
    if alike:
        order = Window.partitionBy("unit_id").orderBy("start")
        company = F.struct("n", "sign")
        asks = held.withColumn("before", F.lag(company).over(order)).where(F.col("before").isNull() | (F.col("before") != company)).drop("before")
    # A hash of many places is split: its places are dealt into blocks, and each pair of blocks is a key of its own.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    block = F.pmod(F.xxhash64("unit_id", "start"), blocks).cast("int")
    asks = asks.withColumns({"block_a": block, "block_b": every}).drop("n", "sign")
    others = held.select("hash", F.col("unit_id").alias("other"), F.col("place").alias("there"), F.col("start").alias("at"), block.alias("block_b"), every.alias("block_a"))
    met = asks.join(others, ["hash", "block_a", "block_b"]).where("place <> there and unit_id <> other")
    left = F.col("unit_id") < F.col("other")
    return met.select(
        F.when(left, F.col("unit_id")).otherwise(F.col("other")).alias("unit_a"),
        F.when(left, F.col("other")).otherwise(F.col("unit_id")).alias("unit_b"),
        F.when(left, F.col("start")).otherwise(F.col("at")).alias("at_a"),
        F.when(left, F.col("at")).otherwise(F.col("start")).alias("at_b"),
    )


def _grown(least: int):
    """All maximal equal intervals of ``least`` code points or more on the diagonals asked for."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_a", "start_b", "chars")])))
    def grown(a: pd.Series, b: pd.Series, shifts: pd.Series) -> pd.Series:
        return pd.Series([_runs(x, y, asked, least) for x, y, asked in zip(a, b, shifts)])

    return grown


def _runs(a: str, b: str, shifts, least: int) -> list[dict]:
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for shift in map(int, shifts):
        i, j = max(shift, 0), max(-shift, 0)
        n = min(len(x) - i, len(y) - j)
        if n < least:
            continue
        ends = np.concatenate(([-1], np.flatnonzero(x[i : i + n] != y[j : j + n]), [n]))
        chars = np.diff(ends) - 1
        out += [{"start_a": i + int(ends[k]) + 1, "start_b": j + int(ends[k]) + 1, "chars": int(chars[k])} for k in np.flatnonzero(chars >= least)]
    return out


def shared_intervals(units: DataFrame, least: int = 200, hot: int = 64) -> tuple[DataFrame, DataFrame]:
    """Where units of different files share ``least`` code points or more.

    Returns (pairs, intervals): ``unit_a, unit_b`` with unit_a < unit_b, and ``unit_id, start, stop``
    of the maximal shared intervals. Null and shorter texts share nothing; a repeated row counts once, and of
    deliveries with different texts each counts; units of one (repo, file) never count as a pair. ``hot`` is only the number of places from which
    on the finer hashes are used; either way the result is whole.
    """
    texts = _texts(units, least)
    windows = _windows(texts, least)
    held = cut_lineage(windows.join(_repeated(windows), "hash").distinct())  # a small part of all windows, read by both ways below
    # A diagonal may have several intervals, and the first one be too short: it is asked for once, and read from end to end.
    diagonals = _pairs_of(held.where(F.col("n") <= hot), False).select("unit_a", "unit_b", (F.col("at_a") - F.col("at_b")).alias("shift")).distinct()
    met = diagonals.groupBy("unit_a", "unit_b").agg(F.array_sort(F.collect_list("shift")).alias("shifts"))
    once = texts.groupBy("unit_id").agg(F.collect_set("text").alias("texts")).select("unit_id", F.explode("texts").alias("text"))
    grown = (
        met.join(once.withColumnsRenamed({"unit_id": "unit_a", "text": "text_a"}), "unit_a")
        .join(once.withColumnsRenamed({"unit_id": "unit_b", "text": "text_b"}), "unit_b")
        .select("unit_a", "unit_b", F.explode(_grown(least)("text_a", "text_b", "shifts")).alias("span"))
    )
    cold_pairs = grown.select("unit_a", "unit_b")
    cold_spans = grown.select(F.explode(F.array(*[F.struct(F.col(f"unit_{k}").alias("unit_id"), F.col(f"span.start_{k}").alias("start"), (F.col(f"span.start_{k}") + F.col("span.chars")).alias("stop")) for k in "ab"])).alias("_")).select("_.*")
    fine = _fine(held.where(F.col("n") > hot), texts, least)
    fine_held = fine.join(_repeated(fine), "hash").distinct()
    hot_spans = fine_held.select("unit_id", "start", (F.col("start") + least).alias("stop"))
    pairs = cold_pairs.union(_pairs_of(fine_held, True).select("unit_a", "unit_b")).distinct()
    return pairs, cold_spans.union(hot_spans)


def _fine(held: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The windows of the full length around each hot one, of the units that hold one."""
    size = least - GAP + 1
    places = held.groupBy("unit_id").agg(F.collect_set("start").alias("starts"))

    def cut(batches):
        for pdf in batches:
            for unit, place, text, starts in zip(pdf["unit_id"], pdf["place"], pdf["text"], pdf["starts"]):
                hashes = window_hashes(text, least)
                at = np.unique(np.concatenate([np.arange(max(0, s + size - least), min(len(hashes), s + 1)) for s in starts]))
                if len(at):
                    yield pd.DataFrame({"hash": hashes[at].view(np.int64), "unit_id": unit, "place": place, "start": at})

    return texts.join(places, "unit_id").mapInPandas(cut, "hash long, unit_id long, place long, start int")


def shared_pairs(units: DataFrame, least: int = 200) -> DataFrame:
    """``unit_a, unit_b`` of different files with ``least`` equal code points in a row; see ``shared_intervals``."""
    return shared_intervals(units, least)[0]


def shared_amounts(units: DataFrame, least: int = 200) -> DataFrame:
    """Per unit: name, chars, shared_chars (code points in intervals shared elsewhere) and the merged intervals' number.

    Every unit has a row; units without text have nulls for chars and 0 shared. Overlapping intervals
    are merged by a running maximum within the unit, whose number of intervals its own text bounds.
    """
    _, spans = shared_intervals(units, least)
    order = Window.partitionBy("unit_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        spans.distinct()
        .withColumn("reach", F.coalesce(reach, F.lit(-1)))
        .groupBy("unit_id")
        .agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach"))).alias("shared"), F.sum((F.col("start") > F.col("reach")).cast("int")).alias("intervals"))
    )
    named = units.groupBy("unit_id").agg(F.min("name").alias("name"), F.max(F.length("full_text")).alias("chars"))
    return named.join(merged, "unit_id", "left").select(
        "unit_id", "name", "chars", F.coalesce("shared", F.lit(0)).cast("long").alias("shared_chars"), F.coalesce("intervals", F.lit(0)).cast("long").alias("intervals")
    )
