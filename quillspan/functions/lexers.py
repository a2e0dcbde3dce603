"""Lexers with a pushdown stack: comments, literals, brackets and block words of a text, and what is wrong with them.

One pattern per language finds the next place that matters. Brackets, block words and the insides of literals
(templates, interpolations) are pushed and must be closed by their own end; here-documents wait for their line,
nested comments count, and each branch of a conditional directive starts from the brackets open before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# File extension -> language.
EXTENSIONS = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "c++": "cpp", "h++": "cpp", "java": "java", "cs": "csharp",
    "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "php": "php", "phtml": "php", "php3": "php", "php4": "php", "php5": "php", "php7": "php", "phps": "php",
}

_CONFLICT = r"(?P<conflict>^(?:<{7}|>{7}|\|{7})(?: [^\n]*)?$|^={7}$)"
_SLASHES = r"(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)"
_MARKS = r"(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<end>;)"
_LINES = _MARKS + r"|(?P<line>\n)"
_LINE = r"\"(?:[^\"\\\n]|\\[\s\S])*\""
_LONG = r"\"(?:[^\"\\]|\\[\s\S])*\""
_CHAR = r"'(?:[^'\\\n]|\\(?:[^\n]))*'"
_SLASH = r"(?P<slash>/)"
_STRAY = r"(?P<stray>/\*|[\"'`])"


def _lexer(*parts: str) -> re.Pattern:
    return re.compile("|".join((_CONFLICT, *parts)), re.M)


_SCRIPT = _lexer(_SLASHES, rf"(?P<text>{_LINE}|{_CHAR})", r"(?P<template>`)", _SLASH, _STRAY, _LINES)
_C = _lexer(
    _SLASHES, r"(?P<directive>^[ \t]*\#(?:[^\n\\]|\\[\s\S])*)", rf"(?P<text>R\"(?P<mark>[^()\\\s]*)\([\s\S]*?\)(?P=mark)\"|{_LINE})", r"(?P<number>\b\d[\w']*)", rf"(?P<char>{_CHAR})", _STRAY, _MARKS,
)
LEXERS = {
    "python": _lexer(
        r"(?P<comment>\#[^\n]*)",
        r"(?P<text>(?:\b[rRbBuUfFtT]{1,2})?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))",
        r"(?P<stray>[\"'`$?])",
        _MARKS,
    ),
    "rust": _lexer(r"(?P<comment>//[^\n]*)", r"(?P<nested>/\*)", rf"(?P<text>\b[bc]?r(?P<hash>\#*)\"[\s\S]*?\"(?P=hash)|{_LONG})", r"(?P<char>'(?:[^'\\\n]|\\[^\n][^'\n]*)'|'[A-Za-z_]\w*)", _STRAY, _MARKS),
    "go": _lexer(_SLASHES, rf"(?P<text>`[^`]*`|{_LINE})", rf"(?P<char>{_CHAR})", _STRAY, _LINES),
    "java": _lexer(_SLASHES, rf"(?P<text>\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|{_LINE})", rf"(?P<char>{_CHAR})", _STRAY, _MARKS),
    "csharp": _lexer(_SLASHES, r"(?P<directive>^[ \t]*\#[^\n]*)", rf"(?P<text>(?P<raw>\"{{3,}})[\s\S]*?(?P=raw)|(?:@\$?|\$@)\"(?:[^\"]|\"\")*\"|\$?{_LINE})", rf"(?P<char>{_CHAR})", _STRAY, _MARKS),
    "php": _lexer(r"(?P<directive>\A(?:(?!<\?)[\s\S])*<\?(?:php|=)?|\?>(?:(?!<\?)[\s\S])*(?:<\?(?:php|=)?|\Z))", _SLASHES, r"(?P<hashed>\#(?!\[)[^\n]*)", r"(?P<text><<<[ \t]*[\"']?(?P<word>\w+)[\"']?\n[\s\S]*?^[ \t]*(?P=word)\b|" + rf"{_LONG}|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`)", _STRAY, _MARKS),
    "cpp": _C, "c": _C, "javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT,
    "ruby": _lexer(
        r"(?P<comment>\#[^\n]*|^=begin\b[\s\S]*?^=end\b[^\n]*)",
        r"(?P<here><<[~\-]?(?P<hq>[\"'`]?)(?P<word>[A-Z]\w*)(?P=hq))",
        r"(?P<percent>(?<![\w)\]}])%[qQwWiIrsx]?[(\[{<|!/](?=[^\n]))",
        r"(?P<quoted>[\"`])", r"(?P<text>'(?:[^'\\]|\\[\s\S])*')", r"(?P<letter>\?[A-Za-z\"'\#/](?!\w))", _SLASH, r"(?P<stray>[\"'`])",
        r"(?P<block>(?<![\w.:@$])(?:def|class|module|begin|case|do|if|unless|while|until|for|end)(?![\w?!:]))", _LINES,
    ),
}
_PARTNER = {")": "(", "]": "[", "}": "{"}
_INSIDE = {q: re.compile(r"(?:[^\\" + re.escape(q) + mark + r"]|\\[\s\S]|" + mark + r"(?!\{))*(" + re.escape(q) + "|" + re.escape(mark) + r"\{)") for q, mark in (("`", "$"), ('"', "#"), ("``", "#"))}
_INSIDE["``"] = re.compile(r"(?:[^\\`#]|\\[\s\S]|#(?!\{))*(`|#\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_RUBY_REGEX = re.compile(r"/(?:[^/\\\n\[#]|\\[^\n]|#(?:\{[^}\n]*\})?|\[(?:[^\]\\\n]|\\[^\n])*\])*/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*%~^<>\n]|=>|(?<![\w.$])(?:return|typeof|case|in|of|delete|void|throw|yield|await|and|or|not|if|unless|when|while|until|puts|match))[ \t]*$")
_MODIFIER = re.compile(r"\s*|.*(?:[=(,;{|]|\b(?:then|else|do|return|and|or|not|begin))\s*")
_CLOSER = {"(": ")", "[": "]", "{": "}", "<": ">"}


@dataclass
class Lexed:
    """``tokens`` are (kind, start, stop), ``pair`` leads from an opening token to its end and back, ``fault`` says what is wrong."""

    tokens: list[tuple[str, int, int]] = field(default_factory=list)
    pair: dict[int, int] = field(default_factory=dict)
    fault: str | None = None


def lex(text: str, language: str) -> Lexed:
    """The tokens of ``text``: run (code between the others), comment, text (any literal), open, close, end, block, directive,
    and line where a line's end may end a statement.

    ``fault`` is the first of merge_conflict, unterminated_literal and unbalanced, or premature_end if something is still
    open at the end; the tokens before it are kept. An empty text has no tokens and no fault.
    """
    out = Lexed()
    tokens, pair, find = out.tokens, out.pair, LEXERS[language].search
    stack: list[tuple[str, int]] = []  # what must close, and the token that opened it
    branches: list[list[tuple[str, int]]] = []
    heres: list[str] = []
    ruby, size, at = language == "ruby", len(text), 0
    loop_line = -2

    def inside(quote: str, start: int, pos: int) -> int:
        """Pass over a literal with interpolations; its code is lexed in between."""
        m = _INSIDE[quote].match(text, pos)
        if not m:
            out.fault = out.fault or "unterminated_literal"
            return size
        tokens.append(("text", start, m.end()))
        if m[1][-1] == "{":
            stack.append((quote, len(tokens)))
            tokens.append(("open", m.end() - 1, m.end()))
        return m.end()

    while at < size:
        m = find(text, at)
        start = m.start() if m else size
        if start > at and (gap := text[at:start].rstrip()) and (bare_gap := gap.lstrip()):
            tokens.append(("run", at + len(gap) - len(bare_gap), at + len(gap)))
        if not m:
            break
        kind, at = m.lastgroup, m.end()
        if kind in ("hash", "mark", "raw", "word", "hq"):
            kind = "here" if ruby else "text"
        if kind == "open":
            stack.append((m[0], len(tokens)))
            tokens.append(("open", start, at))
        elif kind == "close":
            want, index = stack.pop() if stack else ("", -1)
            if want in _INSIDE and m[0] == "}":
                pair[index] = len(tokens)
                tokens.append(("close", start, at))
                at = inside(want, at, at)
            elif want == _PARTNER[m[0]]:
                pair[index] = len(tokens)
                tokens.append(("close", start, at))
            else:
                out.fault = "unbalanced"
                return out
        elif kind == "line":
            tokens.append(("line", start, at))
            for word in heres:
                end = re.compile(rf"^[ \t]*{word}[ \t]*$", re.M).search(text, at)
                if not end:
                    out.fault = "unterminated_literal"
                    return out
                tokens.append(("text", at, end.end()))
                at = end.end()
            heres.clear()
        elif kind == "template" or kind == "quoted":
            at = inside(m[0] if kind == "template" or m[0] == '"' else "``", start, at)
        elif kind == "nested":
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(text, at)):
                depth, at = depth + (1 if n[0] == "/*" else -1), n.end()
            if depth:
                out.fault = "unterminated_literal"
                return out
            tokens.append(("comment", start, at))
        elif kind == "slash":
            regex = (_RUBY_REGEX if ruby else _REGEX).match(text, start) if _BEFORE_REGEX.search(text[max(0, start - 24) : start]) else None
            if regex and not (ruby and text[at : at + 1] in " =" and not _BEFORE_REGEX.search(text[max(0, start - 24) : start].rstrip())):
                tokens.append(("text", start, regex.end()))
                at = regex.end()
            else:
                tokens.append(("run", start, at))
        elif kind == "here":
            value = m["word"]
            if re.search(r"(?:^|[=(,\s\[.])$", text[max(0, start - 1) : start]) and re.compile(rf"^[ \t]*{value}[ \t]*$", re.M).search(text, at):
                heres.append(value)
                tokens.append(("text", start, at))
            else:
                at = start + 2
                tokens.append(("run", start, at))
        elif kind == "percent":
            opener = m[0][-1]
            closer, depth = _CLOSER.get(opener, opener), 1
            letter = m[0][1:2].isalpha()
            if not letter and not re.search(r"(?:^|[=(,\[{\s])$", text[max(0, start - 1) : start]) or (not letter and text[at : at + 1] == " "):
                at = start + 1
                tokens.append(("run", start, at))
                continue
            pos = at
            while depth and pos < size:
                ch = text[pos]
                depth += (ch == opener and opener != closer) - (ch == closer)
                pos += 2 if ch == "\\" else 1
            if depth:
                out.fault = "unterminated_literal"
                return out
            tokens.append(("text", start, pos))
            at = pos
        elif kind == "directive":
            tokens.append(("directive", start, at))
            word = re.sub(r"\W*(\w*)[\s\S]*", r"\1", m[0])
            if word in ("if", "ifdef", "ifndef"):
                branches.append(list(stack))
            elif word in ("else", "elif") and branches:
                stack[:] = branches[-1]
            elif word == "endif" and branches:
                branches.pop()
        elif kind == "conflict":
            out.fault = "merge_conflict"
            return out
        elif kind == "stray":
            out.fault = "unterminated_literal"
            return out
        elif kind == "block":
            index = len(tokens)
            tokens.append(("block", start, at))
            word = m[0]
            if word == "end":
                want, opener = stack.pop() if stack else ("", -1)
                if want != "end":
                    out.fault = "unbalanced"
                    return out
                pair[opener] = index
            elif word == "do":
                if loop_line != (line := text.rfind("\n", 0, start)):
                    stack.append(("end", index))
                elif line == loop_line:
                    loop_line = -2
            else:
                begin = text.rfind("\n", 0, start) + 1
                if word in ("if", "unless", "while", "until") and not _MODIFIER.fullmatch(text[begin:start]):
                    continue
                if word == "def" and _ENDLESS.match(text, start):
                    continue
                stack.append(("end", index))
                if word in ("while", "until", "for"):
                    loop_line = begin - 1
        elif kind == "hashed":
            tokens.append(("comment", start, at))
        elif kind == "number":
            tokens.append(("run", start, at))
        else:
            tokens.append(("comment" if kind == "comment" else "text" if kind in ("text", "char", "letter") else kind, start, at))
    if out.fault is None and stack:
        out.fault = "premature_end"
    return out


_ENDLESS = re.compile(r"def\s+[\w.]+[?!]?(?:\([^()\n]*\))?[ \t]*=[ \t]*[^\s=~]")


def bare(text: str, lexed: Lexed) -> str:
    """The code without comments and directives, each literal as a pair of quotes."""
    parts, at = [], 0
    for kind, start, stop in lexed.tokens:
        if kind in ("comment", "directive", "text"):
            parts.append(text[at:start])
            if kind == "text":
                parts.append('""')
            at = stop
    parts.append(text[at:])
    return "".join(parts)
