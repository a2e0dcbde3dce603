"""Credentials in source text: found by one deterministic automaton, replaced by placeholders.

Token formats, the armor of private keys, connection strings, and the places where a value is given
under a telling name are the patterns of a single automaton (``automaton.py``). It runs over the
texts of a whole Arrow batch, cut into overlapping chunks; each position where a head ends is then
read once more on its own text, to take the exact value and to set aside placeholders, references
and words. Spans are absolute, distinct per text, and spliced out back to front.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton

FIELDS = ("full_text", "compact_text", "skeleton_text")

# The public formats of tokens, by vendor; lengths are those of the part behind the prefix.
TOKEN_FORMATS = [
    ("openai_key", r"sk-(?:proj-|ant-|svcacct-)?", r"[A-Za-z0-9_\-]", 20),
    ("groq_key", r"gsk_", r"[A-Za-z0-9]", 20),
    ("github_token", r"(?:gh[pousr]_|github_pat_)", r"[A-Za-z0-9_]", 20),
    ("npm_token", r"npm_", r"[A-Za-z0-9]", 20),
    ("slack_token", r"xox[abprs]-", r"[A-Za-z0-9\-]", 16),
    ("gitlab_token", r"glpat-", r"[A-Za-z0-9_\-]", 16),
    ("aws_access_key", r"A[KS]IA", r"[A-Z0-9]", 16),
    ("google_key", r"AIza", r"[A-Za-z0-9_\-]", 30),
    ("payment_key", r"[rsp]k_(?:live|test)_", r"[A-Za-z0-9]", 16),
    ("service_key", r"[a-z]{2,6}_(?:live|test|prod)_", r"[A-Za-z0-9]", 20),
    ("signed_token", r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.", r"[A-Za-z0-9_\-]", 16),
]
# Names under which a credential is kept.
NAMES = r"(?:[Ss]ecret|SECRET|[Pp]ass(?:w(?:or)?d|phrase)|PASS(?:W(?:OR)?D|PHRASE)|[Pp]wd|PWD|[Tt]oken|TOKEN|[Aa]pi[_\-]?[Kk]ey|API[_\-]?KEY|[Aa]uth|AUTH|[Cc]redential|CREDENTIAL|[Ss]igning[_\-]?[Kk]ey|SIGNING[_\-]?KEY|[Ee]ncryption[_\-]?[Kk]ey|ENCRYPTION[_\-]?KEY|[Aa]ccess[_\-]?[Kk]ey|ACCESS[_\-]?KEY|[Pp]rivate[_\-]?[Kk]ey|PRIVATE[_\-]?KEY)"


def _head(prefix: str) -> str:
    """What a token's prefix opens with, in the automaton's expressions: up to its first open repeat, counts written out."""
    prefix = re.split(r"\[[^\]]*\]\{\d+,\}", prefix)[0]
    return re.sub(r"(\[[^\]]*\])\{(\d+),(\d+)\}", lambda m: m[1] * int(m[2]) + f"{m[1]}?" * (int(m[3]) - int(m[2])), prefix)


HEADS = {
    "token": r"[^A-Za-z0-9_\-](?:" + "|".join(_head(p) for _, p, _, _ in TOKEN_FORMATS) + r")[A-Za-z0-9_\-]{4}",
    "armor": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "url": r"://",
    "named": NAMES + r"[A-Za-z0-9_\-]*\\?[\"']?\]?[ \t]*[:=,(]",
    "bare": r"(?:" + NAMES + r"|[^A-Za-z0-9_](?:pw|pass|key))(?: is)?[ =:] ?[A-Za-z0-9]",
    "header": r"(?:[Bb]earer|BEARER|Basic|[Aa]pi[Kk]ey|[^A-Za-z]X-[A-Za-z\-]*(?:Token|Key|Auth|Secret)[A-Za-z\-]*:) [A-Za-z0-9]",
    "login": r"(?:[Aa]uth|[Aa]uthenticate|[Ll]ogin|[Ss]ign_?[Ii]n|[Cc]onnect|logon)\(\"",
}

_TOKEN = re.compile("|".join(f"(?P<{n}>{p}{c}{{{k},}})" for n, p, c, k in TOKEN_FORMATS))
_ARMOR = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s|\\n|\\r|[\"'+,#*/])*(?:[A-Z][A-Za-z0-9\-]*: [^\n\\\"']*(?=[\n\\\"'])(?:\s|\\n|\\r|[\"'+,#*/])+)*(?P<body>[A-Za-z0-9+/=]{16}(?:[A-Za-z0-9+/=\s]|\\n|\\r|[\"'+,#*])*)(?:-----END [A-Z ]*PRIVATE KEY-----)?")
# The last @ before the host ends the password, which may hold others.
_URL = re.compile(r"://(?P<user>[^\s/@:\"'`<>\\]*):(?P<value>[^\s/@\"'`\\]+(?:@[^\s/@,;\"'`\\]+)*)@(?=[\w.\-\[\]]+(?::\d+)?(?:[/?\s\"'`,;)\\]|$))")
_URL_TO_FIRST = re.compile(r"://(?P<user>[^\s/@:\"'`<>\\]*):(?P<value>[^\s/@\"'`\\]+)@")
# A line of an environment file, and a pair among others in a connection string.
_SETTING = re.compile(r"[ \t]*(?:export[ \t]+|set[ \t]+|- )?[A-Z][A-Z0-9_.]*[=:][ \t]?$")
_KEYED = re.compile(r"(?i)(?:^|;)[ \t]*[a-z][a-z _\-]*=[ ]?$")
_GIVEN = re.compile(r"""(?:[ \t]*[A-Za-z_&'<>\[\]*? ]{0,30}=|[=>])?[ \t]*(?:concat!\(|String::from\(|b|u|r|R")?(?=\\?["'`])""")
_NAMED = re.compile(r"""[ \t]*(?:concat!\(|String::from\(|b|u|r|R")?(?P<quote>\\?["'`])(?P<value>.*?)(?P=quote)""")
_BARE = re.compile(r"[^\s\"'`,;)\]}<>]+")
# What stands where a credential would, but is none.
PLACEHOLDER = re.compile(
    r"(?i)^(?:$|default|dummy|example|none|null|nil|changeme|change[-_ ]me|replace[-_ ]?(?:me|this).*|not[-_ ]a[-_ ].*|your[-_ ].*|my[-_ ].*|test|secret|password|placeholder|todo|fixme|redacted|n/a|<.*|\[.*|\{\{.*|\$.*|%.*%|%\(.*|#\{.*|vault[:/].*|env[:.].*|ssm:.*|arn:.*|file:.*|https?://.*|(.)\1{5,}|[x*.•#_-]+|.*(?:x{6,}|\*{4,}|\.{3,}|redacted|placeholder|example|dummy|changeme|your[-_]).*)$"
)
_WORDS = re.compile(r"^(?:[a-z]+(?:[-_./: ][a-z]+)*|[A-Z]+(?:[-_][A-Z]+)*|[a-z]+(?:[A-Z][a-z]+)+|\d+|[A-Z]?[a-z]+)$")
# Names that hold something about a credential, not the credential.
_ABOUT = re.compile(r"(?i)(?:count|label|path|file|name|len(?:gth)?|size|limit|type|url|ttl|expiry|hint|id)$")


def _random(value: str) -> bool:
    """Whether a value is no chain of words: it mixes letters with digits or marks, or changes case like no name does."""
    if _WORDS.match(value) or len(value) < 8:
        return False
    if re.search(r"[A-Za-z]", value) and re.search(r"\d", value):
        return True
    return len(value) >= 16 and len(re.findall(r"(?<=[a-z])[A-Z]|(?<=[A-Z]{2})[a-z]", value)) >= 3


def usable(value: str) -> bool:
    """Whether a value under a telling name is a literal credential rather than a stand-in, a path or words."""
    if PLACEHOLDER.match(value) or re.search(r"\s", value) or "${" in value or "{{" in value or "://" in value:
        return False
    if token := _TOKEN.fullmatch(value):
        return _distinct(token[0])
    return _random(value)


def _distinct(token: str) -> bool:
    """A token's random part has many different characters, or digits; masks and chained words have not."""
    body = re.sub(r"^(?:sk-(?:proj-|ant-)?|[a-z]+_(?:live_|test_|prod_)?|glpat-|xox.-|A[KS]IA|AIza)", "", token)
    return len(set(body)) >= 7 and not re.search(r"[xX*]{6}", body) and not re.fullmatch(r"[a-z]+(?:[-_][a-z]+)*", body)


def _joined(text: str, at: int) -> tuple[str, int, int] | None:
    """The value of a quoted literal whose opening quote ends just before ``at``, over pieces set side by side."""
    back = 2 if text[max(0, at - 2) : at - 1] == "\\" else 1
    m = _NAMED.match(text, at - back)
    if not m:
        return None
    value, end = m["value"], m.end()
    quote = m["quote"]
    if quote in "\"'":
        more = re.compile(r"\s*(?:\+|\.\.|,)?\s*" + quote + r"([A-Za-z0-9+/=_\-.]*)" + quote)
        if text[max(0, m.start("quote") - 8) : m.start("quote")].endswith("concat!(") or re.match(r"\s*\+\s*[\"']", text[end:end + 6]):
            while nxt := more.match(text, end):
                value, end = value + nxt[1], nxt.end()
    return value, m.start("value"), end - len(quote)


def _read(text: str, at: int, kind: str) -> tuple[int, int, str] | None:
    """The span and label of the credential whose head of ``kind`` ends at ``at``; None if it is none."""
    if kind == "armor":
        start = text.rfind("-----BEGIN", 0, at)
        m = _ARMOR.match(text, start)
        body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m["body"]) if m else ""
        return (start, m.end(), "private_key") if m and len(set(body)) > 8 else None
    if kind == "token":
        for start in range(at - 5, max(-1, at - 20), -1):
            if start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "_-"):
                break
        m = _TOKEN.match(text, start)
        if m:
            return (start, m.end(), m.lastgroup) if _distinct(m[0]) else None
        if (start and text[start - 1] in "\"'") and (j := _joined(text, start)) and (m := _TOKEN.fullmatch(j[0])):
            return (start, j[2], m.lastgroup) if _distinct(m[0]) else None
        return None
    if kind == "url":
        m = _URL.match(text, at - 3) or _URL_TO_FIRST.match(text, at - 3)
        if not m:
            return None
        value = m["value"]
        weak = PLACEHOLDER.match(value) or value.startswith(("<", "$", "{", "[", "%")) or "${" in value or "{" in value
        return None if weak or len(value) < 4 else (m.start("value"), m.end("value"), "url_password")
    if kind in ("named", "login"):
        if kind == "login":
            second = re.compile(r'[^"\n]*",\s*"').match(text, at)
            at = second.end() if second else at
        else:
            name = _NAMED_HEAD.search(text[_back(text, at) : at])
            given = _GIVEN.match(text, at)
            if not name or not given or _ABOUT.search(name[1]) or (name[3] in ",(" and not name[2]):
                return None
            at = given.end() + (text[given.end()] == "\\") + 1
        if not (j := _joined(text, at)):
            return None
        inner = re.match(r"(?:Bearer|Basic|Token|ApiKey) +", j[0])
        value, start = (j[0][inner.end() :], j[1] + inner.end()) if inner else (j[0], j[1])
        return (start, j[2], "credential") if usable(value) else None
    # bare, header: a word without quotes that begins at the byte the head ends on
    m = _BARE.match(text, at - 1)
    value = m[0].rstrip(".\\") if m else ""
    if kind == "header" and text[max(0, at - 8) : at].startswith("Basic"):
        try:
            plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
            return (at - 1, at - 1 + len(value), "credential") if b":" in plain else None
        except ValueError:
            return None
    if kind == "bare":
        before = text[_back(text, at - 1) : at - 1]
        line = text[text.rfind("\n", 0, at) + 1 : at - 1]
        if re.search(r"(?:^|[^A-Za-z0-9_])(?:--?|[?&])[A-Za-z\-_]+[ =]$", before):
            pass
        elif _SETTING.fullmatch(line) and text[at - 1 + len(m[0]) : at + len(m[0])] in ("", "\n", "\r", " "):
            pass
        elif ";" in line and "=" in line[: line.rfind(";")] and _KEYED.search(line[max(line.rfind('"'), line.rfind("'")) + 1 :]):
            value = re.split(r"[\"';]", value)[0]
        elif not (_comment(text, at) and re.search(r"[0-9]", value)):
            return None
    return (at - 1, at - 1 + len(value), "credential") if usable(value) else None


_NAMED_HEAD = re.compile(r"([A-Za-z0-9_\-]+)(\\?[\"']?)\]?[ \t]*([:=,(])$")


def _back(text: str, at: int) -> int:
    """Where the name before ``at`` begins: back over marks and blanks, then over the name, then two more for what leads it in."""
    k = at
    while k and text[k - 1] in " \t:=,(]\"'\\":
        k -= 1
    while k and (text[k - 1].isalnum() or text[k - 1] in "_-"):
        k -= 1
    return max(0, k - 2)


def _comment(text: str, at: int) -> bool:
    """Whether the line of ``at`` is prose: it opens like a comment, or no operator of code stands before the place."""
    head = text[text.rfind("\n", 0, at) + 1 : at]
    return bool(re.match(r'\s*(?:#|//|/\*|\*|--|"""|[A-Z][a-z]+ )', head) or re.search(r"(?:#|//|/\*) ", head))


@cache
def automaton() -> Automaton:
    """The one automaton of all heads. It is built on the driver and sent with the tasks (under 1 MB)."""
    return Automaton(HEADS)


def spans(texts: list[str], auto: Automaton) -> Iterator[tuple[int, int, int, str]]:
    """(text number, start, end, label) of each credential, by text and place, without overlaps."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([1] + [len(r) + 1 for r in raws])
    ends, masks = auto.scan(b"\n" + b"\n".join(raws))
    rows = np.searchsorted(starts, ends, "right") - 1
    plain = [len(r) == len(t) for r, t in zip(raws, texts)]
    chars: np.ndarray | None = None
    found: list[tuple[int, int, str]] = []
    last = -1
    for row, end, mask in zip(rows.tolist(), ends.tolist(), masks.tolist()):
        if row != last:
            yield from _settled(last, found)
            found, last = [], row
            # Characters up to each byte, once per text.
            chars = None if plain[row] else np.concatenate(([0], np.cumsum((np.frombuffer(raws[row], np.uint8) & 0xC0) != 0x80)))
        at = end - int(starts[row])
        if at > len(raws[row]):
            continue
        if chars is not None:
            at = int(chars[at])
        for k, kind in enumerate(auto.names):
            if mask >> k & 1 and (hit := _read(texts[row], at, kind)):
                found.append(hit)
    yield from _settled(last, found)


def _settled(row: int, found: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int, str]]:
    reach = -1
    for start, end, label in sorted(set(found), key=lambda s: (s[0], -s[1], s[2])):
        if start >= reach:
            yield row, start, end, label
            reach = end


def find_secrets(df: DataFrame, key: str = "unit_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per credential: ``key``, field, line_no (from 1), start and stop (characters), label.

    Null and empty texts give no row; a row delivered twice gives its rows once. Other columns of
    ``df``, whatever their names, are not read.
    """

    auto = automaton()

    def scan(batches):
        for pdf in batches:
            for field in fields:
                have = pdf[pdf[field].notna()]
                texts, keys = have[field].tolist(), have[key].tolist()
                out, row, line, at = [], -1, 1, 0
                for r, s, e, label in spans(texts, auto):
                    if r != row:
                        row, line, at = r, 1, 0
                    line, at = line + texts[r].count("\n", at, s), s
                    out.append((keys[r], field, line, s, e, label))
                if out:
                    yield pd.DataFrame(out, columns=[key, "field", "line_no", "start", "stop", "label"])

    kind = df.schema[key].dataType.simpleString()
    found = df.select(key, *fields).mapInPandas(scan, f"{key} {kind}, field string, line_no int, start int, stop int, label string")
    return found.distinct()


def redact_secrets(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``df`` with each credential in ``fields`` replaced by ``[REDACTED: label]``; all else is kept as it is.

    The replacement is a scalar function of each text, so nothing is shuffled. Nulls stay null.
    """

    auto = automaton()

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        texts = column.where(column.notna(), "").tolist()
        cuts: dict[int, list[tuple[int, int, str]]] = {}
        for row, start, end, label in spans(texts, auto):
            cuts.setdefault(row, []).append((start, end, label))
        for row, parts in cuts.items():
            for start, end, label in reversed(parts):
                texts[row] = f"{texts[row][:start]}[REDACTED: {label}]{texts[row][end:]}"
        return pd.Series(texts).where(column.notna().to_numpy(), None)

    return df.withColumns({f: clean(F.col(f)) for f in fields})
