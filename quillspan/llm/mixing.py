"""Mixing sources to target shares of all tokens.

Every document belongs to domains (the listed sources, and one for all others) softly: a naive Bayes classifier, fitted on a
bounded table of labelled documents, predicts its posteriors, and a given source weighs ``TRUST`` against them. Documents of
equal source and equal rounded posteriors form a class; distributed projected-gradient least squares moves the classes' rates,
the expected number of copies of each document, until the expected tokens of every domain meet their goals within the caps.
Only one sum per domain comes back to the driver per step. Rates become whole copies by carrying what is rounded off over documents in
the order of their size, so that the tokens drawn keep to the rates.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources.tables import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TRUST = 0.96
# A document may be of any domain whose membership is at least this.
MAY = 0.05
GRID = 10
BUCKET = 4096
_LOADED: dict = {}


def token_counter(spark: SparkSession, tokenizer: str | None = TOKENIZER):
    """A function from a text column to its tokens in the public tokenizer at ``tokenizer``; 0 for null.

    The file is read by the driver and handed to the tasks by Spark, so that every task counts in the same unit. A missing
    file is an error. A quarter of the bytes, rounded up, is the unit only where that is asked for, by None.
    """
    if tokenizer is not None and not os.path.isfile(tokenizer):
        raise FileNotFoundError(f"no tokenizer at {tokenizer}; None asks for an estimate by bytes")
    if tokenizer is None:
        return lambda text: F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    @F.pandas_udf("long")
    def count(column: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        texts = column.fillna("").tolist()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if name not in _LOADED:
            _LOADED[name] = Tokenizer.from_file(SparkFiles.get(name))
            _LOADED[name].encode_special_tokens = True
        return pd.Series([n for low in range(0, len(texts), 256) for n in (len(e.ids) for e in _LOADED[name].encode_batch_fast(texts[low : low + 256], add_special_tokens=False))], dtype="int64")

    return count


def memberships(docs: DataFrame, listed: list[str], labelled_rows: int = 20_000, features: int = 4096, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """``doc_id, tokens, source, domain, posterior`` of every document with text, once per doc_id.

    ``domain`` is the given source's number in ``listed`` (its length for an unlisted source, null without source);
    ``posterior`` are whole tenths per domain, of the classifier alone. ``labelled_rows`` bounds the labelled table, a
    documented sample by hash with an equal part for each domain; all documents are classified and counted.
    """
    numbers = F.create_map(*[F.lit(x) for k, n in enumerate(listed) for x in (n, k)]) if listed else F.create_map().cast("map<string,int>")
    number = F.when(F.col("source").isNotNull(), F.coalesce(F.try_element_at(numbers, F.col("source")), F.lit(len(listed))))
    held = docs.where("text is not null and text <> '' and doc_id is not null").select("doc_id", "text", "source").withColumn("domain", number)
    sizes = {r[0]: r[1] for r in held.where("domain is not null").groupBy("domain").count().collect()}
    counted = held.withColumn("tokens", token_counter(docs.sparkSession, tokenizer)(F.col("text")))
    width = len(listed) + 1
    if len(sizes) < 2:  # one domain takes every document, none takes no one
        certain = F.array(*[F.lit(GRID if k in sizes else 0) for k in range(width)])
        return cut(counted.select("doc_id", "tokens", "source", "domain", certain.alias("posterior")).dropDuplicates(["doc_id"]))
    part = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, labelled_rows / len(sizes) / n))])
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    split = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+", minTokenLength=2)
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=features)
    vectors = lambda df: hashed.transform(split.transform(df))
    table = held.where(F.col("domain").isNotNull() & (luck <= F.element_at(part, F.col("domain"))))
    model = NaiveBayes(smoothing=0.5).fit(vectors(table).select("features", F.col("domain").cast("double").alias("label")))
    # Domains without a labelled row have no posterior; labels up to the greatest one seen have their place.
    scored = model.transform(vectors(counted)).select("doc_id", "tokens", "source", "domain", vector_to_array("probability").alias("p"))
    at = lambda k: F.coalesce(F.try_element_at("p", F.lit(k + 1)), F.lit(0.0)) if k in sizes else F.lit(0.0)
    return cut(scored.select("doc_id", "tokens", "source", "domain", F.array(*[F.round(at(k) * GRID).cast("int") for k in range(width)]).alias("posterior")).dropDuplicates(["doc_id"]))


def shares_of(domain: Column, posterior: Column, width: int, trust: float = TRUST) -> Column:
    """The share of each domain in a document: its posteriors, beside ``trust`` for the given one."""
    total = F.aggregate(posterior, F.lit(0), lambda a, x: a + x)
    own = lambda k: F.coalesce((domain == k).cast("double"), F.lit(0.0))
    soft = lambda k: F.when(total > 0, posterior[k] / total).otherwise(own(k))
    return F.array(*[F.when(domain.isNull(), soft(k)).otherwise(trust * own(k) + (1 - trust) * soft(k)) for k in range(width)])


def _may(p: np.ndarray) -> np.ndarray:
    """The domains that a document may belong to: those with a share of MAY or more, and always its likeliest."""
    return p >= np.minimum(MAY, p.max(1, initial=0.0))[:, None]


def _rates(shares: pd.Series, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rate of each class after all steps so far, from its shares alone; so nothing is kept between jobs."""
    p = np.stack(shares.to_numpy()) if len(shares) else np.zeros((0, len(caps)))
    # The least cap of the domains it may belong to, a whole number; so whole copies never exceed what was fitted.
    top = np.where(_may(p), caps, np.inf).min(1, initial=np.inf)
    rate = np.minimum(1.0, top)
    for step in steps:
        rate = np.clip(rate - p @ step, 0.0, top)
    return rate


def attainable(targets: np.ndarray, most: np.ndarray, wanted: float, tolerance: float = 0.008) -> np.ndarray:
    """How many tokens each source should give, of at most ``most``.

    The total is the greatest up to ``wanted`` at which no source is more than ``tolerance`` above its target, though some
    fall short at their most: what they lack is taken up by the others in proportion. Where nothing but sources without any
    tokens is short, no total helps, and the targets are met in proportion.
    """
    share = np.where(most > 0, targets, 0.0)
    if share.sum() <= 0:
        return np.zeros_like(share)
    least = float((share / share.sum() - targets).max())

    def over(total: float) -> float:
        goals = np.minimum(share / share.sum() * total, most)
        return float((goals / goals.sum() - targets).max())

    low, high = 0.0, wanted
    if over(high) > max(tolerance, least + 1e-6):
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if over(max(middle, 1e-9)) <= max(tolerance, least + 1e-6) else (low, middle)
        high = low
    return np.minimum(share / share.sum() * high, most)


def fit_rates(classes: DataFrame, caps: np.ndarray, goal: np.ndarray, have: np.ndarray, rounds: int = 40, speed: float = 0.9) -> list[np.ndarray]:
    """Projected gradient on the classes (``tokens, shares``): the steps by which rates move towards the expected totals."""
    steps: list[np.ndarray] = []
    last = None
    for _ in range(rounds):
        now = _expected(classes.withColumn("rate", _rate_column(caps, steps)), "shares", len(caps))
        enough = 1e-4 * max(1.0, goal.sum())
        if np.abs(now - goal).max() <= enough or (last is not None and np.abs(now - last).max() <= enough):
            break
        steps.append(np.where(have > 0, speed * (now - goal) / np.maximum(have, 1e-9), 0.0))
        last = now
    return steps


def _expected(rated: DataFrame, shares: str, width: int) -> np.ndarray:
    row = rated.agg(*[F.sum(F.col("tokens") * F.col("rate") * F.col(shares)[k]).alias(f"d{k}") for k in range(width)]).first()
    return np.array([v or 0.0 for v in row])


def _rate_column(caps: np.ndarray, steps: list[np.ndarray]):
    @F.pandas_udf("double")
    def rate(shares: pd.Series) -> pd.Series:
        return pd.Series(_rates(shares, caps, steps))

    return rate("shares")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """One row per drawn document: ``doc_id, source, tokens, rate, copies, domains``; copies is at least 1 and within the cap.

    ``domains`` is a map of the document's share in each listed source, without zeros. ``total_tokens`` is the size wanted,
    by default that of all documents of wanted sources; less is drawn where caps would else push other sources off their
    share (see ``attainable``). A source that is not listed, or has a null share, is not drawn; a document without source
    stays within the least cap of the domains it may belong to. ``targets`` is a fixed small table, one row per source. ``tokenizer``: see ``token_counter``.
    """
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.where("source is not null").collect()}
    names = sorted(wanted)
    members = memberships(docs, names, tokenizer=tokenizer)
    width = len(names) + 1
    caps = np.array([float(wanted[n][1]) if wanted[n][0] > 0 else 0.0 for n in names] + [0.0])
    share = np.array([wanted[n][0] for n in names] + [0.0])
    grouped = members.groupBy("domain", "posterior").agg(F.sum("tokens").alias("tokens"))
    told = lambda trust: shares_of(F.col("domain"), F.col("posterior"), width, trust)
    classes = cut(grouped.select("domain", "posterior", "tokens", told(TRUST).alias("shares"), told(1.0).alias("given")))
    have = _expected(classes.withColumn("rate", F.lit(1.0)), "shares", width)
    most = _expected(classes.withColumn("rate", _top_column(caps)), "given", width) * (caps > 0)
    goal = attainable(share * (caps > 0), most, total_tokens if total_tokens is not None else float(have[caps > 0].sum()))
    steps = fit_rates(classes, caps, _softened(classes, goal, most, caps, width), have)
    rates = classes.select(F.struct("domain", "posterior").alias("class"), "shares", F.round(_rate_column(caps, steps), 6).alias("rate"))
    rated = members.withColumn("class", F.struct("domain", "posterior")).join(rates, "class").where("rate > 0")
    named = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in [*names, ""]]), F.col("shares")), lambda name, part: (part > 0) & (name != ""))
    return _drawn(rated).where("copies > 0").select("doc_id", "source", "tokens", "rate", "copies", named.alias("domains"))


def _softened(classes: DataFrame, goal: np.ndarray, most: np.ndarray, caps: np.ndarray, width: int) -> np.ndarray:
    """The expected totals by soft membership of documents whose given sources add up to ``goal``: one row per domain is read."""
    known = classes.where("domain is not null").withColumn("rate", F.lit(1.0))
    total = F.aggregate("posterior", F.lit(0), lambda a, x: a + x)
    rows = known.where(total > 0).groupBy("domain").agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * F.col("posterior")[k] / total).alias(f"d{k}") for k in range(width)]).collect()
    mean, weight = np.eye(width), np.zeros(width)
    for r in rows:
        mean[r["domain"]] = np.array([r[f"d{k}"] or 0.0 for k in range(width)]) / max(1e-9, r["tokens"])
        weight[r["domain"]] = min(1.0, r["tokens"] * caps[r["domain"]] / most[r["domain"]]) if most[r["domain"]] > 0 else 0.0
    moved = (1 - TRUST) * weight * goal
    return goal - moved + moved @ mean


def _top_column(caps: np.ndarray):
    return _rate_column(caps, [np.full(len(caps), -1e9)])


def _drawn(rated: DataFrame) -> DataFrame:
    """Whole copies: from the longest document to the shortest, one more copy wherever the tokens owed so far reach half of it.

    So the tokens drawn keep to the rates within half of the shortest documents. Documents of a source are dealt by hash into
    buckets of about BUCKET, however many it has; each bucket owes on its own.
    """
    sizes = rated.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / BUCKET).alias("_buckets"))
    dealt = rated.join(F.broadcast(sizes), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    narrow = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.col("_buckets"))).drop("_buckets", "class")

    def round_off(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True])
        whole = np.floor(pdf["rate"].to_numpy())
        owed, more = 0.0, np.zeros(len(pdf), np.int64)
        for k, (tokens, part) in enumerate(zip(pdf["tokens"].tolist(), (pdf["rate"].to_numpy() - whole).tolist())):
            owed += tokens * part
            if part > 0 and owed >= tokens / 2:
                more[k], owed = 1, owed - tokens
        pdf["copies"] = whole.astype(int) + more
        return pdf.drop(columns=["bucket"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "bucket") + ", copies int"
    return narrow.groupBy("source", "bucket").applyInPandas(round_off, schema)


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source the share reached beside the target, by source and by soft membership, the documents and copies drawn.

    ``share`` counts the documents of the source itself, and those without source by their share in it; ``soft_share``
    counts all documents so. ``met`` says whether ``share`` is within 0.01 of the target.
    """
    weight = F.col("tokens") * F.col("copies")
    every = drawn.agg(F.sum(weight).alias("every"))
    own = F.when(F.col("source").isNull(), F.col("part")).otherwise((F.col("source") == F.col("name")).cast("double"))
    parts = drawn.select("source", "tokens", "copies", F.explode("domains").alias("name", "part"))
    by = parts.groupBy(F.col("name").alias("source")).agg(
        F.count_if(F.col("source") == F.col("name")).alias("documents"), F.sum(weight * own).alias("drawn_tokens"), F.sum(weight * F.col("part")).alias("soft_tokens"), F.max(F.when(F.col("part") >= MAY, F.col("copies"))).alias("most_copies")
    )
    listed = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    part = lambda c: F.round(F.coalesce(c, F.lit(0.0)) / F.col("every"), 6)
    return listed.join(by, "source", "left").join(F.broadcast(every)).select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce("drawn_tokens", F.lit(0.0))).cast("long").alias("drawn_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        part("drawn_tokens").alias("share"), part("soft_tokens").alias("soft_share"), (F.abs(part("drawn_tokens") - F.coalesce("target_share", F.lit(0.0))) <= 0.01).alias("met"),
    )
