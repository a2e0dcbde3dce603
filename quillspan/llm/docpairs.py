"""Functions and methods paired with the words that say what they do.

Each unit is parsed into its syntax tree (a recursive descent over the lexers of ten languages, Python by its own parser).
The documentation is the delivered doc comment of the function's node, or the one attached to it; of it the describing
sentences are kept, and pairs without any are dropped. Code and documentation come with their exact places.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.trees import Node, parse, walk
from quillspan.sources.files import language_of

COLUMNS = ["unit_id", "language", "signature", "description", "code", "start", "stop", "doc_start", "doc_stop"]
# The order in which a text is tried that its own language finds no function in.
ORDER = ("rust", "go", "python", "ruby", "java", "typescript", "javascript", "cpp", "csharp", "php")

_COMMENT = re.compile(r"/\*+|\*+/|^[ \t]*(?:\*+(?=\s|$)|///?!?|#+)[ \t]?|^[rRuU]*(?:\"\"\"|''')|(?:\"\"\"|''')$", re.M)
# Marks that begin the part of a comment which lists arguments and results.
_TAG = re.compile(r"^\s*(?:[@\\:]\s?\w+|(?:Args?|Arguments|Parameters?|Params|Returns?|Raises|Throws|Yields|Examples?|Usage|Notes?|Attributes|Rückgabe|Parameter|Paramètres|Retour|Retourne|Parámetros|Devuelve)\s*:(?:\s|$)|[-*+]\s+`?\w+`?\s|\w+\s*:\s*\w+$|\|)")
# Openings and wordings of comments that are no description.
_NOTICE = re.compile(
    r"(?i)^\W*(?:(?:todo|fixme|xxx|hack|tbd|wip|n/?a)\b|(?:nosonar|noqa|nolint|clang-format|fmt|yapf|isort|flake8|pylint|eslint|tslint|rubocop|mypy|istanbul|coverage|pragma)\b\s*(?:[:\-]|$|no\b|ignore\b|disable\b|off\b|on\b)|eslint-|prettier-|type:\s*ignore|@?ts-|spdx\b|copyright\b|\(c\)|©|all rights reserved|licensed? (?:under|to)\b|see license|permission is hereby|redistribution\b"
    r"|auto-?generated\b|generated (?:at|by|from)\b|@+generated\b|code generated\b|<auto|.*\bdo(?: not|n.t) (?:edit|modify)\b|machine[- ](?:written|made|generated)\b|this file (?:was|is) (?:produced|created|generated|written|built)\b|produced (?:by|automatically)\b"
    r"|\(non-javadoc\)|\{@inheritdoc\}|inherited(?: from\b|[.!]?$)|default constructor\b|constructor\.?$|summary goes here|description (?:pending|goes here|here)|write docs\b|docs? (?:pending|missing|to come)|document(?: this| me)?\.?$|no (?:docs?|description|documentation)\b|missing docs?\b|add (?:docs?|description)(?: here| later)?[.!]?$"
    r"|placeholder\b|fill in(?: here| later)?[.!]?$|lorem ipsum|deprecated\.?$|see (?:above|below|also)\b|same as above|ditto\b|as above\b|method stub|stub\.?$|(?:end of|begin|(?:end)?region)\b(?:\s+\w+){0,3}\W*$|={3,}|-{3,}|\*{3,}|~{3,})"
)
_CODE = re.compile(r"^\s*(?:(?:let|const|var|auto|return|if|for|while|def|fn|func|function|class|import|from|public|private|protected|static|int|void|else|end|raise|throw|panic!|self\.)\b.*[;(){}=:]|.*;\s*$|.*[{}]\s*$|[\w.\[\]]+\s*(?::=|[-+*/|&]?=)\s*\S.*|[\w.]+(?:::\w+)*!?\([^)]*\)\s*;?$)")
_UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def words_of(name: str) -> list[str]:
    """The words of an identifier, in lower case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", name or "")]


def prose(comment: str) -> list[str]:
    """The describing lines of a comment: without marks, tags and what follows them, notices, code and ornament."""
    out, tagged = [], False
    for line in _COMMENT.sub("", comment.strip()).split("\n"):
        line = line.strip().strip("\"'").strip()
        if not line:
            tagged = False if tagged == "one" else tagged
            continue
        if _TAG.match(line) and not re.match(r"@(?:brief|summary|description|details)\b", line):
            tagged = "all"
            continue
        if tagged or _NOTICE.match(line) or _CODE.match(line) or not _WORD.search(line):
            continue
        out.append(re.sub(r"^@\w+\s+", "", line))
    return out


def description(comment: str | None, name: str | None) -> str | None:
    """The words in ``comment`` that say what the function ``name`` does; None if there are none.

    Null, empty and blank comments, ornament, reminders, notices, disabled code, lists of arguments
    alone, and comments of fewer than four words or of the name's own words are no description.
    """
    lines = prose(comment or "")
    text = " ".join(lines).strip()
    words = [w.lower() for w in _WORD.findall(text)]
    # Scripts without blanks between words: two characters count as one word, and none of them repeats a name.
    together = sum(len(run) for run in _UNSPACED.findall(text)) // 2
    if together >= 4:
        return text
    if len(words) < 4:
        return None
    own = {w.rstrip("s") for w in words_of(name or "")}
    new = {w for w in words if w.rstrip("s") not in own and w not in {"the", "a", "an", "this", "function", "method", "of", "to", "for", "and", "in"}}
    if len(new) < 3:
        return None
    return text


def function_node(text: str, lang: str | None, kind: str, name: str | None) -> Node | None:
    """The node of the function ``name`` in the syntax tree of ``text``; a method is read as if its class stood around it.

    A text that is none of its file's language (a wrong extension) is read in the first other language that finds a
    function in it. Where no node has the name, the first one counts.
    """
    for language in (lang, *[k for k in ORDER if k != lang]):
        if language is None:
            continue
        found = [n for n, _ in walk(parse(text, language, "class" if kind == "method" else "script")) if n.kind in ("function", "method")]
        if found:
            return next((n for n in found if n.name.rsplit("::", 1)[-1] == name), found[0])
    return None


def _above(text: str, start: int) -> tuple[int, int] | None:
    """The comment lines right above a Python definition without a docstring."""
    m = re.search(r"(?:^[ \t]*#(?!!)[^\n]*\n)+[ \t]*\Z", text[:start], re.M)
    return (m.start(), m.end()) if m else None


def pair(doc_comment: str | None, text: str | None, name: str | None, kind: str, lang: str | None) -> tuple | None:
    """(description, code, start, stop, doc_start, doc_stop) of one function, places in characters of ``text``.

    None without code, without a function's node, or without a description. A delivered documentation comes before the one
    attached to the node; the places of the latter are null where the former is taken.
    """
    if not isinstance(text, str) or not text.strip() or (node := function_node(text, lang, kind, name)) is None:
        return None
    doc = node.doc or (_above(text, node.start) if lang == "python" else None)
    told, place = (description(doc_comment, name) if isinstance(doc_comment, str) else None), (None, None)
    if told is None and doc:
        told, place = description(text[doc[0] : doc[1]], name), doc
    if told is None:
        return None
    return told, text[node.start : node.stop], node.start, node.stop, *place


def doc_pairs(units: DataFrame) -> DataFrame:
    """``unit_id, language, signature, description, code, start, stop, doc_start, doc_stop`` of each documented function.

    A narrow job: one pass over the whole texts, each parsed into its syntax tree, without a shuffle but the last one that
    removes rows delivered twice. Nulls in any column make no pair, except a null signature, which stays null.
    """

    def read(batches):
        for pdf in batches:
            made = [(u, lang, s, *p) for u, lang, s, n, k, d, t in zip(pdf["unit_id"], pdf["language"], pdf["signature"], pdf["name"], pdf["kind"], pdf["doc_comment"], pdf["full_text"]) if (p := pair(d, t, n, k, lang))]
            if made:
                out = pd.DataFrame(made, columns=COLUMNS)
                yield out.astype({c: "Int64" for c in COLUMNS[5:]})

    functions = units.where(F.col("kind").isin("function", "method") & F.col("full_text").isNotNull())
    ready = functions.select("unit_id", language_of(F.col("file")).alias("language"), "signature", "name", "kind", "doc_comment", "full_text")
    schema = T.StructType([T.StructField("unit_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in COLUMNS[1:5]], *[T.StructField(n, T.LongType()) for n in COLUMNS[5:]]])
    return ready.mapInPandas(read, schema)
