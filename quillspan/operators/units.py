"""Reading code units, cutting texts into chunks, and searching them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import estimate_tokens
from quillspan.sources.tables import latest


def current_units(units: DataFrame, columns: list[str]) -> DataFrame:
    """One row per unit_id, the latest delivered, with the columns asked for; null ids are dropped."""
    return latest(units.select("unit_id", *columns, "ingested_at").where("unit_id is not null"), ["unit_id"], "ingested_at").drop("ingested_at")


def chunk_texts(docs: DataFrame, lines: int = 50) -> DataFrame:
    """Chunks of ``lines`` lines of each text: doc_id, chunk (from 1), signature, n_lines, tok_full.

    A trailing newline ends the last line. Null and empty texts give no chunk; whole texts are cut.
    """
    body = F.regexp_replace("text", "\r?\n$", "")
    rows = docs.where("text is not null and text <> ''").select("doc_id", F.split(body, "\r?\n", -1).alias("rows"))
    cut = rows.select("doc_id", "rows", F.explode(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / lines).cast("int"))).alias("k"))
    part = cut.select("doc_id", (F.col("k") + 1).alias("chunk"), F.slice("rows", F.col("k") * lines + 1, lines).alias("part"))
    text = F.array_join("part", "\n")
    return part.select("doc_id", "chunk", F.trim(F.element_at("part", 1)).alias("signature"), F.size("part").alias("n_lines"), estimate_tokens(text).alias("tok_full"))


def mentions(pattern: str) -> Column:
    """Whether name, signature, kind, file, doc comment or a reference of a unit has ``pattern``, in any case; nulls have none."""
    low = pattern.lower()
    told = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(low)) for c in ("name", "signature", "kind", "file", "doc_comment")]
    return told[0] | told[1] | told[2] | told[3] | told[4] | F.exists(F.coalesce("refs", F.array().cast("array<string>")), lambda r: F.coalesce(F.contains(F.lower(r), F.lit(low)), F.lit(False)))


def grep(units: DataFrame, pattern: str) -> DataFrame:
    """Units that mention ``pattern``."""
    return units.where(mentions(pattern))


def snippet(text, lines: int = 5):
    """The first lines of a text."""
    return F.substring_index(text, "\n", lines)

