"""Syntax trees of definitions: a recursive descent over the lexers' tokens, and Python's own parser for Python.

A tree has a node for each definition and for each block that is none; statements end the heads before them. The head of a
block (its runs of code, with groups and literals folded) decides what the block is, by the forms of its language.
"""

from __future__ import annotations

import ast
import re
import textwrap
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

from quillspan.functions.lexers import Lexed, lex


@dataclass
class Node:
    """A definition or a block: kind ('' for a mere block), name, range of characters, where its body begins, its documentation."""

    kind: str
    name: str
    start: int
    stop: int
    body: int = -1
    doc: tuple[int, int] | None = None
    children: list[Node] = field(default_factory=list)


_ID = r"[A-Za-z_$][\w$]*"
_TYPES = {"struct": "struct", "union": "struct", "enum": "enum", "class": "class", "interface": "interface", "trait": "trait", "record": "class"}
_CONTROL = r"(?!(?:if|else|for|foreach|while|switch|catch|do|try|finally|return|new|throw|match|loop|select|case|when|using|lock|await|yield|with|unless|until|go|defer|assert|synchronized|fixed|checked|unchecked|delete|sizeof|typeof|function|fn)\b)"
_ANNOTATED = r"(?:@(?!interface\b)[\w.]+(?:\(\))?\s*)*"
_JAVA = rf"{_ANNOTATED}(?:\[\]\s*)*(?:(?:public|private|protected|internal|static|final|abstract|sealed|non-sealed|synchronized|default|native|strictfp|transient|volatile|virtual|override|async|partial|readonly|extern|unsafe|new|required)\s+)*"
_FORMS = {
    "rust": [rf"(?:#!?\[\]\s*)*(?:pub\s*(?:\(\))?\s*)?(?:(?:default|async|unsafe|const|extern(?:\s*\"\")?)\s+)*(?P<kind>fn|struct|enum|union|trait|type|mod)\s+(?P<name>{_ID})", rf"(?:#!?\[\]\s*)*(?:unsafe\s+)?(?P<kind>impl)\b(?:\s*<[^{{]*?>(?=\s*[\w&]))?\s*&?(?:\w+::)*(?P<name>{_ID})", rf"(?:#!?\[\]\s*)*(?:pub\s*(?:\(\))?\s*)?(?P<kind>const|static)\s+(?:mut\s+)?(?P<name>{_ID})\s*:"],
    "go": [rf"(?P<kind>func)\s*(?P<owner>\(\)\s*)?(?P<name>{_ID})\s*[(\[]", rf"(?P<kind>type)\s+(?P<name>{_ID})"],
    "java": [rf"{_JAVA}(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>{_ID})", rf"{_JAVA}(?:<[^()]*?>\s*)?{_CONTROL}(?:[\w.$]+(?:\s*<[^()]*>)?(?:\s*\[\])*(?:\s*@[\w.]+)*\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|synchronized\b|super\b|this\b)(?P<method>{_ID})\s*\(\)\s*(?:\[\]\s*)*(?:throws\b[\w.,\s<>@]*)?$"],
    "csharp": [rf"{_JAVA}(?P<kind>class|interface|enum|struct|record|namespace)\s+(?:struct\s+|class\s+)?(?P<name>{_ID}(?:\.{_ID})*)", rf"{_JAVA}{_CONTROL}(?:[\w.]+(?:<[^()]*>)?(?:\[\])*\??\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|using\b|lock\b|foreach\b|base\b|this\b)(?P<method>~?{_ID})\s*(?:<[^()]*>)?\s*\(\)\s*(?::\s*(?:base|this)\s*\(\)\s*)?(?:where\b.*)?(?:=>.*)?$", rf"{_JAVA}{_CONTROL}[\w.]+(?:<[^()]*>)?(?:\[\])*\??\s+(?P<property>{_ID})$"],
    "script": [rf"{_ANNOTATED}(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?P<kind>class|interface|enum|namespace)\s+(?!extends\b|implements\b)(?P<name>{_ID})", rf"(?:export\s+)?(?:declare\s+)?(?P<kind>type)\s+(?P<name>{_ID})\s*(?:<.*?>\s*)?=", rf"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:async\s+)?(?P<kind>function)\s*\*?\s*(?P<name>{_ID})", rf"{_ANNOTATED}(?:(?:public|private|protected|static|readonly|override|async|get|set|abstract)\s+)*[*#]?{_CONTROL}(?P<method>{_ID})\s*\??\s*(?:<[^()]*>)?\s*\(\)\s*(?::[^=;]*)?$"],
    "cpp": [r"(?:template\s*<[^{]*>\s*)?(?:inline\s+|export\s+)*(?P<kind>namespace)\s+(?P<name>[\w:]+)", rf"(?:template\s*<[^{{]*?>\s*)?(?:typedef\s+|static\s+|const\s+|extern\s+)*(?P<kind>class|struct|union|enum)\s+(?:class\s+|struct\s+)?(?:alignas\(\)\s*|\[\]\s*|[A-Z_]+\s+(?=[A-Za-z]))*(?P<name>{_ID})\s*(?::(?!:)[^()]*|final\s*(?::.*)?)?$", rf"(?P<kind>using)\s+(?P<name>{_ID})\s*=", rf"(?P<kind>typedef)\b[\s\S]*?(?P<name>{_ID})\s*(?:\[\]|\(\))*$", rf"(?:template\s*<[^{{]*>\s*)?(?:\[\]\s*)*{_CONTROL}(?:[\w:<>,*&\s\[\]]*?[\s*&>])??{_CONTROL}(?P<func>(?:\w+(?:<[^()]*>)?::)*(?:~?{_ID}|operator\s*(?:[^\w\s(]+|\(\)|\w+)))\s*\(\)\s*(?:const|noexcept(?:\(\))?|override|final|volatile|&&?|->[\s\w:<>,*&]+|requires.*|try|\s)*(?::(?!:)[\s\S]*)?$"],
    "php": [rf"(?:#?\[\]\s*)*(?:(?:public|private|protected|static|abstract|final|readonly)\s+)*(?P<kind>function|class|interface|trait|enum)\s+&?\s*(?P<name>{_ID})"],
}
_FORMS |= {"javascript": _FORMS["script"], "typescript": _FORMS["script"], "tsx": _FORMS["script"], "c": _FORMS["cpp"]}
FORMS = {k: [re.compile(f) for f in v] for k, v in _FORMS.items()}
_KINDS = {**_TYPES, "@interface": "interface", "fn": "function", "func": "function", "function": "function", "impl": "impl", "namespace": "impl", "mod": "", "type": "type", "using": "type", "typedef": "type", "const": "const", "static": "const"}
# Declarations that a semicolon (in Go a line's end) completes; elsewhere a head without a body defines nothing.
_BODILESS = {"rust": {"struct", "type", "const", "static"}, "go": {"type"}, "java": {"method"}, "csharp": {"method", "record"}, "cpp": {"using", "typedef", "struct", "enum", "class", "union"}, "c": {"typedef", "struct", "enum", "union"}, "javascript": set(), "typescript": {"type"}, "tsx": {"type"}, "php": set()}
_BY_LINE = ("go", "javascript", "typescript", "tsx")
_CLASSES = ("class", "struct", "interface", "trait", "enum", "impl", "record")
_GOES_ON = re.compile(r"(?:[=+\-*/%&|^,.(<>?:]|\b(?:return|extends|implements|throws|where|async|function|const|static|public|private|protected|abstract|export|default))$")
_CONTINUES = re.compile(r"\s*(?:[.?:=+*&|,)\]]|=>|extends\b|implements\b|throws\b|where\b|->)")


# What a declaration without a body may begin with.
_MAY_END = re.compile(r"[@#<\[]|[A-Za-z_]\w*(?:\s*\(\s*\w+\s*\))?\s+[A-Za-z_]|[\w.<>\[\]]+\s*\(")
NOTHING = ("", "", False)


class _Reader:
    """Reads one text into nodes; ``at`` walks over its tokens."""

    def __init__(self, text: str, language: str, lexed: Lexed):
        self.text, self.language, self.lexed = text, language, lexed
        self.forms, self.bodiless = FORMS[language], _BODILESS[language]

    def shape(self, head: list[tuple[str, int, int]]) -> str:
        fold = {"(": "()", "[": "[]", "{": "{}"}
        parts, last = [], None
        for kind, start, stop in head:
            if last is not None and self.text[last:start].strip(" \t\r\n") == "" and start > last:
                parts.append(" ")
            parts.append(self.text[start:stop] if kind == "run" else '""' if kind == "text" else fold[self.text[start]])
            last = stop
        return re.sub(r"\s+", " ", "".join(parts))

    def told(self, shape: str, ended: bool, owner: str) -> tuple[str, str, bool]:
        """(kind, name, whether it is a definition) of a head before a body, or before its end."""
        for form in self.forms:
            if not (m := form.match(shape)):
                continue
            found = m.groupdict()
            word = found.get("kind") or ("method" if found.get("method") else "property" if found.get("property") else "func")
            if ended and (word not in self.bodiless or (word == "method" and owner not in _CLASSES)):
                return "", "", False
            if word == "property":
                return ("const", found["property"], True) if owner in _CLASSES else ("", "", False)
            name = found.get("name") or found.get("method") or found.get("func") or ""
            kind = _KINDS.get(word, "function")
            if word == "method":
                kind = "method"
                if self.language in ("javascript", "typescript", "tsx") and owner not in ("class", "", "script"):
                    return "", "", False
            elif word in ("func", "function") and (found.get("owner") or (self.language == "php" and owner in _CLASSES)):
                kind = "method"
            return kind, name, kind != ""
        return "", "", False

    def block(self, at: int, end: int, owner: str, top: bool = False) -> list[Node]:
        """The nodes between two tokens."""
        tokens, pair, text = self.lexed.tokens, self.lexed.pair, self.text
        nodes: list[Node] = []
        head: list[tuple[str, int, int]] = []
        inner: list[Node] = []
        comments: list[tuple[int, int]] = []

        def finish(stop: int, body: int = -1, children: list[Node] | None = None, told: tuple[str, str, bool] = NOTHING) -> None:
            nonlocal head, inner, comments
            if head:
                if body < 0 and self.bodiless and _MAY_END.match(text, head[0][1]) and (owner in _CLASSES or self.language not in ("java", "csharp")):
                    told = self.told(self.shape(head), True, owner)
                kind, name, is_definition = told
                if is_definition:
                    nodes.append(Node(kind, name, head[0][1], stop, body, _attached(text, comments, head[0][1]), (children or []) + inner))
                elif body >= 0:
                    nodes.append(Node("", "", head[0][1], stop, body, None, (children or []) + inner))
                else:
                    nodes.extend(inner)
            elif children:
                nodes.append(Node("", "", body, stop, body, None, children))
            head, inner, comments = [], [], []

        while at < end:
            kind, start, stop = tokens[at]
            if kind == "comment":
                if not head:
                    comments.append((start, stop))
            elif kind == "line":
                if head and self.language in _BY_LINE and not self._goes_on(head, at, end):
                    finish(head[-1][2])
            elif kind == "end":
                finish(stop)
            elif kind == "directive":
                head, inner, comments = [], [], []
            elif kind == "open":
                close = pair.get(at, end)
                last = tokens[close][2] if close < end else len(text)
                shape = self.shape(head) if text[start] == "{" and head else ""
                if text[start] == "{" and not self._expression(head, shape):
                    told = self.told(shape, False, owner) if head else NOTHING
                    children = self.block(at + 1, min(close, end), told[0] if told[2] else (owner if shape.startswith(("namespace", "mod ", "extern")) else "body"))
                    semi = self._semicolon(close + 1, end) if told[2] and told[0] in ("class", "struct", "enum", "type") and self.language in ("c", "cpp") else None
                    finish(last, start, children, told)
                    close = close if semi is None else semi
                else:
                    inner += self.block(at + 1, min(close, end), "group")
                    head.append(("group", start, last))
                at = close
            elif kind in ("run", "text"):
                if self.language in ("c", "cpp") and not head and kind == "run" and (label := re.match(r"(?:public|private|protected|case\b[^:]*|default)\s*:(?!:)\s*", text[start:stop])):
                    start += label.end()
                if start < stop:
                    head.append((kind, start, stop))
            at += 1
        if head and top:
            # Where the text breaks off within a head, what it would have defined still counts.
            told = self.told(self.shape(head), False, owner) if self.lexed.fault else NOTHING
            finish(head[-1][2], len(text) if told[2] else -1, None, told)
        nodes.extend(inner)
        return nodes

    def _expression(self, head: list, shape: str) -> bool:
        """Whether a brace behind this head belongs to an expression, or to an initialiser."""
        if not head:
            return False
        kind, start, stop = head[-1]
        tail = self.text[start:stop].rstrip() if kind == "run" else ""
        if tail.endswith(("=", "=>", "return", ",", ":", "?", "+", "&&", "||")) and not tail.endswith("=>") and self.language != "python":
            return True
        if self.language in ("c", "cpp") and shape.startswith("typedef"):
            return True
        if self.language == "go" and re.match(r"(?:var|const)\b|.*(?::=|[^=!<>]=)(?!=)", shape) and not re.match(r"(?:if|for|switch|select|func)\b", shape):
            return True
        if self.language == "rust" and re.match(r"(?:let|return)\b", shape) and kind == "run" and not re.search(r"\b(?:match|if|else|loop|unsafe|while)\b", shape):
            return True
        return self.language == "cpp" and kind == "run" and bool(re.search(r"\(\)[^(]*:(?!:)[^{]*\w$", shape)) and not shape.startswith(("class", "struct", "enum"))

    def _goes_on(self, head: list, at: int, end: int) -> bool:
        """Whether a statement goes on behind a line's end."""
        kind, start, stop = head[-1]
        if kind == "run" and _GOES_ON.search(self.text[start:stop].rstrip()):
            return True
        if len(head) <= 2 and self.text[head[0][1]] == "@":
            return True
        if self.language != "go":
            nxt = next((t for t in self.lexed.tokens[at + 1 : min(end, at + 6)] if t[0] not in ("line", "comment")), None)
            if nxt and (nxt[0] == "open" and self.text[nxt[1]] == "{" or nxt[0] == "run" and _CONTINUES.match(self.text[nxt[1] : nxt[2]])):
                return True
        return False

    def _semicolon(self, at: int, end: int) -> int | None:
        for k in range(at, end):
            kind = self.lexed.tokens[k][0]
            if kind == "end":
                return k
            if kind not in ("line", "comment", "run", "text"):
                return None
        return None


def _attached(text: str, comments: list[tuple[int, int]], start: int) -> tuple[int, int] | None:
    """The run of comments that ends on the line above ``start`` (or on its own line), without a gap in between."""
    first = None
    edge = start
    for a, b in reversed(comments):
        if text.count("\n", b, edge) > 1 or text[text.rfind("\n", 0, a) + 1 : a].strip():
            break
        first = (a, first[1] if first else b)
        edge = a
    return first


def _ruby(text: str, lexed: Lexed) -> list[Node]:
    """Ruby's definitions: block words and their ends."""
    root = Node("", "", 0, len(text))
    open_nodes: list[tuple[int, Node]] = [(len(lexed.tokens), root)]
    comments: list[tuple[int, int]] = []
    for at, (kind, start, stop) in enumerate(lexed.tokens):
        while len(open_nodes) > 1 and at > open_nodes[-1][0]:
            open_nodes.pop()
        if kind == "comment":
            comments.append((start, stop))
            continue
        if kind == "block" and text[start:stop] in ("def", "class", "module") and (m := _RUBY_HEAD.match(text, start)):
            close = lexed.pair.get(at)
            endless = close is None and text[start:stop] == "def"
            last = lexed.tokens[close][2] if close is not None else (text.find("\n", start) if endless and "\n" in text[start:] else len(text))
            begin = start
            if pre := re.search(r"(?:private|protected|public|module_function|private_class_method)[ \t]+$", text[max(0, start - 32) : start]):
                begin = start - (len(pre[0]))
            node = Node({"def": "method", "class": "class", "module": "impl"}[m["kind"]], m["name"].rsplit("::", 1)[-1] if m["kind"] == "def" else m["name"], begin, last, m.end(), _attached(text, comments, begin))
            open_nodes[-1][1].children.append(node)
            open_nodes.append((close if close is not None else at, node))
            comments = []
        elif kind not in ("line",):
            comments = []
    return root.children


_RUBY_HEAD = re.compile(r"(?P<kind>def|class|module)\s+(?:self\.|\w+\.(?=\w))?(?P<name>[\w:]+[?!=]?|[+\-*/<>=!~\[\]%]+)(?:[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*\)|[^\n;]*)?")


def _python(text: str) -> list[Node] | None:
    """Python's definitions from its own syntax tree; None if the text does not parse."""
    indent = re.match(r"[ \t]*", text)[0]
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text if not indent else textwrap.dedent(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    shift = 0 if not indent else len(text.split("\n", 1)[0]) - len(textwrap.dedent(text).split("\n", 1)[0])
    raw = text.split("\n")
    lines = [0]
    for line in raw:
        lines.append(lines[-1] + len(line) + 1)
    wide = [not line.isascii() for line in raw]

    def place(row: int, column: int) -> int:
        line = raw[row - 1]
        column += shift if line.strip() else 0
        return lines[row - 1] + (len(line.encode("utf-8", "replace")[:column].decode("utf-8", "ignore")) if wide[row - 1] else column)

    def visit(owner) -> list[Node]:
        out = []
        for child in ast.iter_child_nodes(owner):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child, *child.decorator_list], key=lambda n: n.lineno)
                begin = place(first.lineno, first.col_offset - (first is not child))
                stop, head = place(child.end_lineno, child.end_col_offset), child.body[0]
                doc = None
                if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str):
                    doc = place(head.lineno, head.col_offset), place(head.end_lineno, head.end_col_offset)
                out.append(Node("class" if isinstance(child, ast.ClassDef) else "function", child.name, begin, stop, place(head.lineno, head.col_offset), doc, visit(child)))
            else:
                out += visit(child)
        return out

    return visit(tree)


def parse(text: str, language: str, owner: str = "script") -> list[Node]:
    """The nodes of a text, outermost first.

    ``owner`` is what stands around the text: for a method on its own its class. A text with a fault gives the nodes up to
    it, of which the last may be cut off by the text's end; in Python, where the syntax tree needs a whole text, the heads
    of definitions found by their indentation.
    """
    if language == "python" and (nodes := _python(text)) is not None:
        return nodes
    lexed = lex(text, language)
    if language == "python":
        return _python_heads(text, lexed)
    if language == "ruby":
        return _ruby(text, lexed)
    return _Reader(text, language, lexed).block(0, len(lexed.tokens), owner, True)


_PYTHON_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)


def _python_heads(text: str, lexed: Lexed) -> list[Node]:
    """Definitions of a Python text that does not parse: each reaches to the next line that is indented no deeper."""
    literal = [(a, b) for kind, a, b in lexed.tokens if kind in ("text", "comment")]
    root: list[Node] = []
    stack: list[tuple[int, Node]] = []
    for m in _PYTHON_HEAD.finditer(text):
        if any(a <= m.start(2) < b for a, b in literal):
            continue
        depth = len(m[1].expandtabs())
        while stack and stack[-1][0] >= depth:
            stack.pop()
        after = re.compile(rf"^(?![ \t]{{{len(m[1]) + 1},}}|[ \t]*$|[ \t]*[)\]}}#])", re.M).search(text, min(len(text), text.find("\n", m.end()) + 1 or len(text)))
        stop = len(text[: after.start()].rstrip()) if after else len(text)
        colon = re.compile(r":[ \t]*(?:#[^\n]*)?\n\s*").search(text, m.end(), stop)
        body = colon.end() if colon else -1
        doc = next(((a, b) for a, b in literal if a == body and text[a] != "#"), None)
        node = Node("class" if m[2] == "class" else "function", m[3], m.start() + len(m[1]), stop, body, doc)
        (stack[-1][1].children if stack else root).append(node)
        stack.append((depth, node))
    return root


def walk(nodes: list[Node], depth: int = 0) -> Iterator[tuple[Node, int]]:
    """All definitions below ``nodes``, each before those inside it, with how many definitions are around it."""
    for node in nodes:
        if node.kind:
            yield node, depth
        yield from walk(node.children, depth + bool(node.kind))
