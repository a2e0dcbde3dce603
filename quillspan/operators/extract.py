"""Extracting units at three levels of detail from whole source files.

Python tasks only find where definitions, their documentation and their calls stand; the levels of detail, token counts
and references are column expressions on what they find.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.lexers import EXTENSIONS, lex
from quillspan.functions.text import estimate_tokens
from quillspan.functions.trees import Node, parse, walk

MARK = "body elided"
CHUNK = 50
# Words that are no callee, being keywords and common types, and calls too common to tell anything.
KEYWORDS = """let fn def self this super int str bool float double void i8 i16 i32 i64 u8 u16 u32 u64 usize isize f32 f64 char String Vec Option Result Some None Ok Err
true false nil null undefined return if else for while loop match switch case break continue mut pub public private protected internal static final virtual override abstract
var const function class struct enum type interface import export from as package namespace use using mod crate async await yield try catch finally throw pass end include""".split()
COMMON_CALLS = """println print format panic assert assert_eq assert_ne console log info warn error debug trace len count is_empty is_none is_some is_ok is_err clone to_string as_str
to_owned into from unwrap expect push pop insert remove contains get map iter collect and_then or_else trim split lines replace substring slice join find starts_with ends_with equals
toString valueOf hasOwnProperty append make new""".split()
QUIET = frozenset(KEYWORDS) | frozenset(COMMON_CALLS)
# Kinds whose text stays whole at every level.
WHOLE = ("enum", "type", "const")
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<path>(?:[A-Za-z_$][\w$]*(?:\(\))?\s*(?:\?\.|\.|::|->)\s*)*)(?P<name>[A-Za-z_$][\w$]*)!?\s*(?:::)?(?:<[\w\s,:&]*>)?\(")
_MADE = re.compile(r"(?:[=(,&:]|\breturn)\s*&?(?P<path>(?:\w+(?:\.|::))*)(?P<name>[A-Z]\w*)\s*\{")
_DEFINES = re.compile(r"(?:\b(?:def|fn|func|function|class|struct|enum|trait|interface|impl|type)\s+(?:self\.)?|\bfunc\s*\([^()]*\)\s*)$")
SPANS = "repo string, file string, language string, kind string, name string, doc_comment string, signature string, full_text string, head string, start_line int, end_line int, chunk boolean, calls array<struct<callee:string,qualifier:string,line:int>>"


def _blank(text: str, language: str) -> str:
    """The text with comments and literals overwritten, every other character at its place."""
    parts, at = [], 0
    for kind, start, stop in lex(text, language).tokens:
        if kind in ("comment", "text", "directive"):
            parts += [text[at:start], re.sub(r"[^\n]", " ", text[start:stop])]
            at = stop
    return "".join(parts) + text[at:]


def _sites(code: str, language: str, nodes: list[Node]) -> list[tuple[int, str, str | None]]:
    """(place, callee, qualifier) of each call and each construction, without the heads of definitions."""
    heads = {(n.name, k) for n in nodes for k in [code.find(n.name, n.start, n.body if n.body > 0 else n.stop)]}
    found = []
    for m in _CALL.finditer(code):
        if (m["name"], m.start("name")) not in heads and not _DEFINES.search(code[max(0, m.start("name") - 60) : m.start("name")]):
            found.append((m.start("name"), m["name"], re.sub(r"\s*(?:\?\.|\.|::|->)\s*$", "", m["path"]) or None))
    if language in ("go", "rust"):
        found += [(m.start("name"), m["name"], m["path"].rstrip(".:") or None) for m in _MADE.finditer(code)]
    return sorted(found)


def _dedent(text: str, start: int, stop: int) -> str:
    """A comment or docstring without the indentation of its first line."""
    indent = start - (text.rfind("\n", 0, start) + 1)
    return re.sub(rf"\n[ \t]{{1,{indent}}}", "\n", text[start:stop]) if indent else text[start:stop]


def spans_of(path: str, text: str) -> Iterator[tuple]:
    """Where the units of one file stand; chunks of lines where nothing is defined. Unknown languages and blank texts give none."""
    language = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())
    if language is None or not text.strip():
        return
    nodes = [n for n, _ in walk(parse(text, language))]
    if not nodes:
        lines = re.split(r"\r?\n", re.sub(r"\r?\n$", "", text))
        stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
        for k in range(0, len(lines), CHUNK):
            part = "\n".join(lines[k : k + CHUNK])
            yield language, "function", f"{stem}_part_{k // CHUNK + 1}", None, lines[k].strip(), part, "", k + 1, min(k + CHUNK, len(lines)), True, []
        return
    sites = _sites(_blank(text, language), language, nodes)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(breaks, at) + 1
    for n in nodes:
        full, name = text[n.start : n.stop], n.name or "<anonymous>"
        head = text[n.start : n.body].rstrip() if n.body > 0 else ""
        head = head[:-1].rstrip() if head.endswith("{") else re.sub(r"(?:\n[ \t]*#[^\n]*)+\Z", "", head) if language == "python" else head
        signature = full.split("\n", 1)[0].strip() if "\n" not in head else re.sub(r"\s+", " ", head)
        calls = [(c, q, line(a)) for a, c, q in sites[bisect_left(sites, (n.start,)) :] if a < n.stop and c != n.name and len(c.encode()) > 1 and c not in QUIET] if sites else []
        yield language, n.kind, name, _dedent(text, *n.doc) if n.doc else None, signature, full, head, line(n.start), line(max(n.start, n.stop - 1)), False, calls


def _levels() -> tuple[Column, Column]:
    """The compact and the skeleton text, as expressions on a span; never longer than the full one but for a leading doc comment."""
    full, head, language, kind = F.col("full_text"), F.col("head"), F.col("language"), F.col("kind")
    note = lambda what: (
        F.when(language == "python", f"\n    ...  # {what}").when(language == "ruby", f"\n  # ... {what} ...\nend").when(language == "go", f"\n    // ... {what} ...\n}}").otherwise(f"\n    /* ... {what} ... */\n}}")
    )
    opened = F.when(language.isin("python", "ruby"), head).otherwise(F.concat(head, F.lit(" {")))
    doc = F.when((language == "python") & F.col("doc_comment").isNotNull(), F.concat(F.lit("\n    "), F.col("doc_comment"))).otherwise("")
    lines = F.split(F.regexp_replace(F.substring(full, F.length(head) + 1, F.length(full)), r"\r?\n$", ""), r"\r?\n", -1)
    inner = F.filter(F.slice(lines, 2, F.greatest(F.lit(1), F.size(lines))), lambda x: (F.trim(x) != "") & (F.trim(x) != "{"))
    body = F.array_join(F.slice(inner, 1, 5), "\n")
    shorter = lambda made: F.when(F.octet_length(made) < F.octet_length(full), made).otherwise(full)
    whole = kind.isin(*WHOLE) | (head == "")
    skeleton = F.when(whole, full).otherwise(shorter(F.concat(opened, doc, note(MARK))))
    compact = F.when(whole | (F.size(F.split(full, "\n", -1)) <= 8), full).otherwise(shorter(F.concat(opened, F.lit("\n"), body, note("remaining " + MARK))))
    chunk_lines = F.split(full, "\n", -1)
    cut = F.concat(F.trim(chunk_lines[0]), F.lit("\n"), F.array_join(F.slice(chunk_lines, 2, 5), "\n"))
    lead = F.when((language != "python") & F.col("doc_comment").isNotNull(), F.concat(F.col("doc_comment"), F.lit("\n"))).otherwise("")
    chunk = F.col("chunk")
    return F.when(chunk & (F.size(chunk_lines) > 10), cut).when(chunk, full).otherwise(F.concat(lead, compact)), F.when(chunk, F.col("signature")).otherwise(F.concat(lead, skeleton))


def extract(files: DataFrame) -> DataFrame:
    """Units of ``files`` (repo, file, content): one narrow pass. Null contents and files of other languages give none.

    Definitions inside others are units too. Texts that cannot be read give the definitions that could be; texts without
    any give chunks of 50 lines. Callees are named with their qualifier and line, without keywords and calls too common.
    """

    def find(batches):
        names = [c.split()[0] for c in SPANS.split(", ")]
        for pdf in batches:
            out = [(r, f, *u) for r, f, t in zip(pdf["repo"], pdf["file"], pdf["content"]) if isinstance(t, str) and isinstance(f, str) for u in spans_of(f, t)]
            if out:
                made = pd.DataFrame(out, columns=names)
                made["calls"] = [[{"callee": c, "qualifier": q, "line": n} for c, q, n in calls] for calls in made["calls"]]
                yield made

    spans = files.select("repo", "file", "content").mapInPandas(find, SPANS)
    compact, skeleton = _levels()
    leveled = spans.withColumns({"compact_text": compact, "skeleton_text": skeleton, "refs": F.array_sort(F.array_distinct(F.col("calls.callee")))})
    size = lambda c: F.when(F.col("chunk"), estimate_tokens(F.col(c))).otherwise(F.least(estimate_tokens(F.col(c)), estimate_tokens(F.col("full_text"))))
    return leveled.withColumns({"tok_full": estimate_tokens(F.col("full_text")), "tok_compact": size("compact_text"), "tok_skeleton": size("skeleton_text")}).drop("head", "chunk", "language")


def assembled(units: DataFrame) -> DataFrame:
    """``repo, file, content``: files put together from their outermost units (see ``outermost``), each at its own line.

    Doc comments outside Python stand above their unit. The texts of one file come together, which its length bounds; gaps
    between units are empty lines. Null texts, files and lines are left out.
    """
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    held = outermost(units.where("full_text is not null and file is not null and start_line is not null"))
    lead = F.when(F.col("doc_comment").isNotNull() & ~F.col("file").rlike(r"\.pyi?$") & ~F.startswith("full_text", F.col("doc_comment")), F.concat("doc_comment", F.lit("\n"))).otherwise("")
    text = held.withColumn("text", F.concat(lead, "full_text"))
    placed = text.select("repo", "file", F.struct((F.col("start_line") - lines(lead) + 1).alias("first"), "unit_id", "text", lines(F.col("text")).alias("n")).alias("part"))
    parts = F.array_sort(F.collect_list("part"))
    files = placed.groupBy("repo", "file").agg(parts.alias("parts"))
    # Each part follows the line on which the one before it ends.
    after = lambda p, i: F.when(i == 0, 1).otherwise(F.col("parts")[i - 1]["first"] + F.col("parts")[i - 1]["n"])
    padded = F.transform("parts", lambda p, i: F.concat(F.repeat(F.lit("\n"), F.greatest(F.lit(0), p["first"] - after(p, i))), p["text"], F.lit("\n")))
    return files.select("repo", "file", F.array_join(padded, "").alias("content"))


def outermost(units: DataFrame) -> DataFrame:
    """Units that lie in no other one of their (repo, file), by their lines; of equal ranges the least id stays."""
    order = Window.partitionBy("repo", "file").orderBy("start_line", F.desc("end_line"), "unit_id").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("_reach", F.max("end_line").over(order)).where("_reach is null or _reach < end_line or _reach < start_line").drop("_reach")
