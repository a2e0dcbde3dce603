"""Personal information in free text, found by a linear-chain conditional random field.

The model is trained on the driver from a small labelled table (``pii_table.py``), whose slots are filled by rule from a
fixed seed. It goes to the tasks (a few MB, bounded by the table), which score and decode their lines in numpy batches. The
labels of a value are then checked for the form that its type has, and the value is replaced by a typed placeholder.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_table
from .crf import Model, Tokens, tokens_of

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
COPIES = 12
PIECE = 400_000


def labelled(copies: int, seed: int, table: str = pii_table.LABELLED, plain: str = pii_table.PLAIN) -> tuple[Tokens, list[str]]:
    """The tokens of the labelled table, one sentence a line, and the label of each."""
    rows = pii_table.sentences(copies, seed, table, plain)
    tokens = tokens_of("\n".join(t for t, _ in rows))
    begin = np.cumsum([0] + [len(t) + 1 for t, _ in rows])
    labels = ["O"] * len(tokens.words)
    for k, (_, spans) in enumerate(rows):
        for a, b, kind in spans:
            low, high = np.searchsorted(tokens.starts, (begin[k] + a, begin[k] + b))
            for t in range(low, high):
                labels[t] = ("B-" if t == low else "I-") + kind
    return tokens, labels


@lru_cache(maxsize=4)
def trained(lexicon: tuple[tuple[str, str], ...], copies: int = COPIES, table: str = pii_table.LABELLED, plain: str = pii_table.PLAIN) -> Model:
    """The model trained on the labelled table; ``lexicon`` gives names with their roles, as features only."""
    model = Model(["O", *[f"{b}-{t}" for t in TYPES for b in "BI"]], dict(lexicon))
    tokens, labels = labelled(copies, 7, table, plain)
    # In training some names pass as known and most as unknown, as in the lexicon's own gaps.
    r = random.Random(11)
    names = sorted({w.lower() for w, t in zip(tokens.words, labels) if t.endswith("person_name") and len(w) > 2})
    model.lexicon = {w: r.choice(("given", "family")) for w in names if r.random() < 0.3}
    model.train(tokens, np.array([model.labels.index(t) for t in labels]))
    model.lexicon = dict(lexicon)
    model.forget()
    return model


_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_FLAT = re.compile(r"\s*,?\s*(?:\b(?:Apt|Apartment|Flat|Suite|Unit|Room|Whg|Wohnung|appt|app|étage|esc|piso|puerta)\b|[A-Z]?\d{5}\b)", re.I)
# A street's name has a capital letter, or one of the words that streets are called by.
_STREET = re.compile(r"[^\W\d_a-zß-öø-ÿ]|\b(?:rue|avenue|boulevard|quai|place|impasse|allée|chemin|cours|calle|avenida|plaza|paseo|camino|ronda|straße|str|weg|gasse|allee|platz)\b")
_FRENCH = "rue|avenue|boulevard|quai|place|impasse|allée|chemin|cours"
_ENGLISH = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Way|Court|Close|Row|Square|Place|Crescent|Terrace"
_DIALLED = re.compile(r"\(?\+?\(?\d(?:[ .\-/]{0,3}\(?\d+\)?)+")
_PARTICLE = r"(?:v[ao]n|de[rnslm]?|da|d[iou]s?|la|le|los?|las|zu[mr]?|ter|ten|y|e|af|av|al|el|bin|ibn)"
_NAME = re.compile(rf"(?:[^\W\d_](?:[\w'’]|-(?=\w))+|[A-Z]\.)(?:,? (?:{_PARTICLE} )*(?:[^\W\d_](?:[\w'’]|-(?=\w))+|[A-Z]\.))*")


def _completed(text: str, start: int, end: int) -> tuple[int, int]:
    """An address with the rest of its street's name, where the decoded part stops before it."""
    value = text[start:end].rstrip(" ,")
    end = start + len(value)
    if re.search(rf"^\d+\w?(?: (?:bis|ter))?,? (?:{_FRENCH})(?: (?:d[ue]s?|de la|de l))?$", value, re.I) and (m := re.compile(r"(?: (?:d[ue]s?|de la|de l))?[ '’][^\W\d_][\w\-]+").match(text, end)):
        return start, m.end()
    if re.match(r"\d", value) and not re.search(rf"(?:{_ENGLISH})\.?$", value) and (m := re.compile(rf"(?: [A-Z][\w'’\-]+)?? (?:{_ENGLISH})\b").match(text, end)):
        return start, m.end()
    return start, end


def _checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The exact span of a decoded value, if it has the form of its type."""
    value = text[start:end]
    if kind == "email":
        for m in _EMAIL.finditer(text, max(0, start - 64), end + 64):
            if m.start() < end and m.end() > start:
                return None if text[m.end() : m.end() + 1] == ":" and m[0].startswith("git@") else m.span()
        return None
    if kind == "person_name":
        end = start + len(value.rstrip(" ,;:!?<(-"))
        value = text[start:end]
        if value.endswith(".") and not re.search(r"(?:^|[ ,])[A-Z]\.$", value):
            end, value = end - 1, value[:-1]
        if not _NAME.fullmatch(value) or any(w[0].islower() and not re.fullmatch(_PARTICLE, w) for w in re.findall(r"(?<!['’\w])[^\W\d_]{2,}", value)) or value[:1].islower() or re.match(r"[_(@+\-]|\.\w", text[end : end + 2]):
            return None
        return (start, end) if len(value) > 2 else None
    if kind == "phone":  # a number goes on over what is glued to it, or one mark further
        low, high = max(0, start - 12), end + 12
        grown = next((m.span() for m in _DIALLED.finditer(text, low, high) if m.start() < end and m.end() > start), None)
        if grown and grown[0] <= start + 1 and grown[1] >= end and sum(ch.isdigit() for ch in text[slice(*grown)]) <= 13 and sum(map(str.isdigit, value)) >= 6 and not re.search(r"[\w:]$", text[max(0, grown[0] - 1) : grown[0]]):
            start, end = grown
            value = text[start:end]
    if kind == "street_address":
        start, end = _completed(text, start, end)
        value = text[start:end]
    digits = sum(ch.isdigit() for ch in value)
    if kind == "phone":
        if re.search(r"\d[:.]$", text[max(0, start - 2) : start]):
            return None
        return (start, end) if 7 <= digits <= 15 and re.fullmatch(r"[+(]?[\d() /.\-+]+\d", value) else None
    if kind == "id_number":
        letters = sum(ch.isalpha() for ch in value)
        return (start, end) if digits >= 6 and letters <= 4 and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9 .\-/]*[A-Za-z0-9]", value) else None
    if flat := _FLAT.search(value):
        end, value = start + flat.start(), value[: flat.start()]
    if len(re.findall(r"\d+", value)) > 1 or not re.search(r"[^\W\d_][\w.]*[^\W\d_.]", value) or not _STREET.search(value):
        return None
    if re.search(r"\b(?:St|Rd|Ave|Dr|Ln)$", value) and text[end : end + 1] == ".":
        end, value = end + 1, value + "."
    elif value.endswith(".") and not re.search(r"\b(?:St|Rd|Ave|Dr|Ln)\.$", value):
        end, value = end - 1, value[:-1]
    return (start, end) if 1 <= digits <= 5 and re.search(r"[^\W\d_]{2}", value) and "\n" not in value else None


def values_in(texts: list[str], model: Model) -> list[list[tuple[int, int, str]]]:
    """Per text the (start, end, type) of its values, in order and without overlaps. Lines are decoded many at a time."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    low = 0
    while low < len(texts):
        high, chars = low, 0
        while high < len(texts) and (high == low or chars + len(texts[high]) <= PIECE):
            chars += len(texts[high]) + 1
            high += 1
        _values(texts, low, high, model, found)
        low = high
    return found


def _values(texts: list[str], low: int, high: int, model: Model, found: list) -> None:
    whole = "\n".join(texts[low:high])
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[low:high]])
    tokens = tokens_of(whole)
    tags = model.decode(tokens)
    marked = np.flatnonzero(tags)
    rows = np.searchsorted(begin, tokens.starts[marked], "right") - 1
    names, k = [model.labels[t] for t in tags[marked].tolist()], 0
    at, line = marked.tolist(), tokens.line[marked].tolist()
    while k < len(at):
        kind, stop = names[k][2:], k + 1
        while stop < len(at) and names[stop] == f"I-{kind}" and at[stop] == at[stop - 1] + 1 and line[stop] == line[k]:
            stop += 1
        row = int(rows[k])
        text, base = texts[low + row], int(begin[row])
        span = _checked(text, int(tokens.starts[at[k]]) - base, int(tokens.ends[at[stop - 1]]) - base, kind)
        if span and (not found[low + row] or found[low + row][-1][1] <= span[0]):
            found[low + row].append((*span, kind))
        k = stop


def _model(lexicon: DataFrame):
    """The trained model, broadcast. The lexicon is a fixed list of names (a few hundred rows)."""
    names = {(r[0].lower(), r[1]) for r in lexicon.where("name is not null and role is not null").select("name", "role").distinct().collect()}
    return lexicon.sparkSession.sparkContext.broadcast(trained(tuple(sorted(names))))


def find_pii(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct ``doc_id, pii_type, pii_text``. Null and empty texts have none; a narrow job up to the last distinct."""
    shared = _model(lexicon)

    def scan(batches):
        model = shared.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            out = [(d, kind, t[s:e]) for d, t, spans in zip(pdf["doc_id"], texts, values_in(texts, model)) for s, e, kind in spans]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "pii_type", "pii_text"])

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(scan, "doc_id long, pii_type string, pii_text string").distinct()


def redact_pii(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``docs`` with each value in ``text`` replaced by its type in brackets; the rest of the text stays as it is."""
    shared = _model(lexicon)

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        texts = column.where(column.notna(), "").tolist()
        for row, spans in enumerate(values_in(texts, shared.value)):
            for s, e, kind in reversed(spans):
                texts[row] = f"{texts[row][:s]}[{kind.upper()}]{texts[row][e:]}"
        return pd.Series(texts).where(column.notna().to_numpy(), None)

    return docs.withColumn("text", clean("text"))
