"""Lexical scores of units against a query, and the boosts on top of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import stem, term_set

# Words that call up a concept, and the words that come with it.
CONCEPTS = [
    ("leak leaking leakage", "dispose free close drop cleanup release drain flush destroy dealloc"),
    ("auth authenticate authenticat authorization authoriz", "jwt token session login logout credential permission oauth bearer user"),
    ("conn connection connect", "pool socket client session handshake channel stream transport"),
    ("db database sql", "query table pool store storage repo persist entity migration tx"),
    ("cache caching", "memoize lru store lookup hit miss evict ttl entry expire"),
    ("config configure configuration", "setting option env param preference toml yaml json flag"),
    ("fix bug patch", "repair resolve correct handle error panic fault recover"),
    ("find search", "lookup query get locate discover fetch scan index"),
    ("init initialize setup", "create construct new build start instantiate load open"),
    ("budget limit", "cost quota token capacity trim allocate threshold ceiling"),
    ("parse parsing", "ast syntax grammar tree token lex extract traverse visitor"),
    ("rank ranking", "score relevance weight priority sort order heuristic bm25"),
    ("dedupe deduplicate duplicate twice repeat idempotent throttle debounce", "dedupe unique distinct filter throttle debounce cache singleton idempotent once replay request"),
]
NEAR = 0.75


def expand_terms(questions: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, weight``: the words and stems of each question at 1, and those of the concepts it calls up at 0.75.

    A word calls up a concept if it equals one of its callers, has the same stem, or the stem of the word is
    the caller's beginning or begins with it. The concepts are a fixed small table and are broadcast; which
    concepts a word calls up is settled once per distinct word, not per question. Null keys are dropped, null
    and empty texts have no terms, repeated rows count once.
    """
    spark = questions.sparkSession
    rows = [(n, c, s) for n, (callers, near) in enumerate(CONCEPTS) for c in callers.split() for s in [near]]
    concepts = spark.createDataFrame(rows, "concept int, caller string, near string")
    called = concepts.select("concept", "caller", stem(F.col("caller")).alias("caller_stem"))
    near = concepts.select("concept", F.explode(term_set(F.col("near"))).alias("term")).distinct()
    own = questions.select(F.col(key).alias("_key"), F.explode(term_set(F.coalesce(F.col(text), F.lit("")))).alias("term")).where("_key is not null").distinct()
    words = own.select("term").distinct().withColumn("root", stem(F.col("term")))
    meets = (F.col("caller") == F.col("term")) | (F.col("caller_stem") == F.col("root")) | F.startswith("caller", "root") | F.startswith("root", "caller")
    calls = words.join(F.broadcast(called), meets).select(F.col("term").alias("word"), "concept").distinct()
    added = own.join(calls, F.col("term") == F.col("word")).select("_key", "concept").distinct().join(F.broadcast(near), "concept")
    every = own.withColumn("weight", F.lit(1.0)).union(added.select("_key", "term", F.lit(NEAR)))
    return every.groupBy(F.col("_key").alias(key), "term").agg(F.max("weight").alias("weight"))


def _related(query: dict[str, float]) -> str:
    """A pattern of the words that can match any term: the term; from four bytes on also what it begins, and its own beginnings."""
    forms = []
    for term in sorted(query):
        long = len(term.encode()) >= 4
        forms.append(re.escape(term) + ("[\\s\\S]*" if long else ""))
        forms += [re.escape(term[:k]) for k in range(1, len(term)) if long and len(term[:k].encode()) >= 4]
    return f"^(?:{'|'.join(forms)})$" if forms else "^$"


def _may_relate(query: dict[str, float]) -> str:
    """A pattern of the words whose stem may match a term: a stem begins like its word (but for -ies), and of two that match one begins the other."""
    starts = sorted({re.escape(t[:2].lower()) for t in query})
    return f"^(?:{'|'.join(starts)})|ies$" if starts else "^$"


def _best(terms: Column, term: Column) -> Column:
    """1 for the term itself, 0.85 where one is a prefix of the other and both have four bytes or more, else 0."""
    close = F.exists(terms, lambda t: (F.octet_length(t) >= 4) & (F.startswith(t, term) | F.startswith(term, t)))
    return F.when(F.array_contains(terms, term), 1.0).when((F.octet_length(term) >= 4) & close, 0.85).otherwise(0.0)


def lexical_scores(units: DataFrame, query: dict[str, float]) -> DataFrame:
    """``units`` with score parts: name 4, doc 3.5 and signature 1.5 times weight; body 0.8 where these three miss.

    ``query`` maps terms to weights. The total is the sum over 1 + signature terms / 50. Null texts
    have no terms. Of each text's words one pattern first keeps those whose stem may match, so that a handful is
    stemmed and compared; only the signature, whose length counts, is stemmed whole.
    """
    terms, related = sorted(query), F.lit(_related(query))
    texts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("name", "doc_comment", "full_text")])
    near = _may_relate(query)
    words = units.withColumns({"_few": F.transform(texts, lambda t: term_set(t, near)), "_sig": term_set(F.coalesce(F.col("signature"), F.lit("")))})
    words = words.withColumns({"_sets": F.array(F.col("_few")[0], F.col("_few")[1], F.col("_sig"), F.col("_few")[2]), "_n_sig": F.size("_sig")})
    hits = words.withColumn("_hits", F.transform("_sets", lambda s: F.filter(s, lambda w: F.rlike(w, related))))
    asked = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    told = hits.withColumn("_best", F.transform("_hits", lambda s: F.transform(asked, lambda t: _best(s, t))))
    zero = F.lit(0.0)
    parts = {"name_score": zero, "doc_score": zero, "sig_score": zero, "body_score": zero}
    matched = []
    for i, term in enumerate(terms):
        weight = query[term]
        n, d, s, b = (F.col("_best")[k][i] for k in range(4))
        head = n + d + s
        parts["name_score"] += 4.0 * weight * n
        parts["doc_score"] += 3.5 * weight * d
        parts["sig_score"] += 1.5 * weight * s
        parts["body_score"] += F.when(head == 0, 0.8 * weight * b).otherwise(0.0)
        matched.append(F.when(head + b > 0, F.lit(term)))
    scored = told.withColumns({**parts, "matched_terms": F.array_compact(F.array(*matched).cast("array<string>")), "_length": 1 + F.col("_n_sig") / 50})
    total = (F.col("name_score") + F.col("doc_score") + F.col("sig_score") + F.col("body_score")) / F.col("_length")
    return scored.withColumn("score", F.round(total, 6)).drop("_few", "_sig", "_sets", "_n_sig", "_hits", "_best", "_length")


def centrality_boost(scores: DataFrame, centrality: DataFrame, weight: float = 0.5) -> DataFrame:
    """Adds min(2 weight centrality, 4); where no score is positive every unit first counts 1. No weight, no change."""
    if weight <= 0:
        return scores
    base = scores.agg((F.coalesce(F.max("score"), F.lit(0.0)) > 0).alias("any"))
    joined = scores.join(centrality, "unit_id", "left").join(F.broadcast(base))
    boost = F.least(F.lit(4.0), 2 * weight * F.coalesce("centrality", F.lit(0.0)))
    return joined.withColumn("score", F.round(F.when(F.col("any"), F.col("score")).otherwise(1.0) + boost, 6)).drop("any", "centrality")


def session_boost(accesses: Column) -> Column:
    """min(1.5 (1 + 0.25 min(accesses, 3)), 3)."""
    return F.least(F.lit(3.0), 1.5 * (1 + 0.25 * F.least(accesses, F.lit(3))))


def age_decay(position: Column) -> Column:
    """max(0.1, 1 / (1 + 0.15 position)), the newest at position 0."""
    return F.greatest(F.lit(0.1), 1 / (1 + 0.15 * position))


def add_boost(scores: DataFrame, boosts: DataFrame, key: str, weight: float = 1.0) -> DataFrame:
    """``scores`` with weight times each boost of ``boosts`` (key, boost) added; keys without one, and null keys, keep their score."""
    once = boosts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("boost").alias("_boost"))
    joined = scores.join(once, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("score", F.round(F.col("score") + weight * F.coalesce("_boost", F.lit(0.0)), 6)).drop("_key", "_boost")
