"""What cannot be read as a definition or a script of its language: faults of the lexers' stack, and forms that no text of it has."""

from __future__ import annotations

import ast
import re
import textwrap
import warnings

from quillspan.functions.lexers import Lexed, bare, lex

_NAME = r"[A-Za-z_$][\w$]*"
_ARGS = r"\([^()]*(?:\([^()]*\)[^()]*)*\)"
# The forms a definition or a script of each language may begin with, after comments and literals are blanked.
HEADS = {
    "python": re.compile(rf"(?:async\s+)?def\s+{_NAME}\s*\([\s\S]*?\)\s*(?:->[^\n:]+)?:|class\s+{_NAME}\s*(?:{_ARGS})?\s*:|@|import\s+\w|from\s+[\w.]+\s+import\b|(?:if|for|while|with|try)\b[^\n]*:\s*$|{_NAME}(?:[.\[][^=\n(]*)?\s*(?::[^=\n]+)?(?:[-+*/|&]?=(?!=)|\([^\n]*\)\s*$)|''|pass\s*$|\"", re.M),
    "ruby": re.compile(rf"def\s+(?:self\.)?{_NAME}[?!=]?(?:\s*\([^)\n]*\)\s*$|\s*$|\s+[a-z_*&][^:\n]*$|\s*\()|(?:class|module)\s+[A-Z][\w:]*(?:\s*<\s*[A-Z][\w:]*)?\s*$|require|[A-Za-z_@]\w*\s*(?:\|\|)?=(?!=)|(?:if|unless|while|begin|puts|attr_\w+|include|private|until|case|raise|return)\b|[a-z_][\w.]*(?:\([^{{;\n]*\)\s*$|\s+do\b)", re.M),
    "rust": re.compile(r"(?:#!?\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern|default)\s+)*(?:fn|struct|enum|impl|trait|type|const|static|mod|use|union|macro_rules!)\b(?!\s*\()|(?:let|for|while|loop|match|if)\b[^\n]*(?:[;{]|$)|[a-z_][\w.:!]*\([^\n]*\)\s*;"),
    "go": re.compile(rf"func\s+(?:\([^)]*\)\s*)?{_NAME}\s*[\[(]|type\s+{_NAME}\s+\S|(?:var|const)\s+(?:\(|{_NAME})|package\s+\w|import\b|(?:for|if|switch)\b[^\n(]*\{{|[a-z_][\w.]*(?:\s*:=|\([^\n;]*\)\s*$)", re.M),
    "java": re.compile(rf"(?:@{_NAME}(?:{_ARGS})?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:(?:class|interface|enum|record|@interface)\s+{_NAME}|(?:<[^>]*>\s*)?{_NAME}(?:\.{_NAME})*(?:<[^()]*>)?(?:\[\])*\s+{_NAME}\s*[(=;]|{_NAME}\s*\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?\{{)|package\s|import\s|(?:for|while|if|switch)\s*\([^\n]*\{{|[a-z]\w*(?:\.\w+)*\([^\n]*\)\s*;"),
    "cpp": re.compile(rf"#|using\b|namespace\b|template\s*<|(?:(?:static|inline|constexpr|const|virtual|explicit|extern|typedef|friend|unsigned|signed)\s+)*(?:(?:class|struct|union|enum(?:\s+class)?)\s+{_NAME}|[~]?{_NAME}(?:::{_NAME})*(?:<[^()]*>)?(?:\s*[*&]+)?\s*(?:(?:const\s*)?[*&]*\s*~?{_NAME}(?:::~?{_NAME})*(?:\[\w*\])*\s*[(=;{{]|\([^)]*\)\s*[{{:;]))"),
    "javascript": re.compile(rf"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\b\s*\*?\s*(?:{_NAME})?\s*\((?![^)]*:)[^)]*\)\s*\{{|(?:export\s+(?:default\s+)?)?class\s+{_NAME}(?:\s+extends\s+[\w$.]+)?\s*\{{|(?:export\s+)?(?:const|let|var)\s+[\w$\[{{]|(?:(?:async|static|get|set)\s+)*[*#]?(?!function\b|if\b|for\b|while\b|switch\b){_NAME}\s*\((?![^)]*:)[^)]*\)\s*\{{|import\b|export\s*[{{*]|(?:for|while|if|switch)\s*\([^\n]*\{{|(?:throw|return)\b|[\w$.]+\s*(?:=(?!=)|\([^\n]*\)\s*;)|[\"'(;!]"),
    "typescript": re.compile(rf"(?:@{_NAME}(?:{_ARGS})?\s*)*(?:export\s+(?:default\s+)?|declare\s+)*(?:async\s+|abstract\s+)*(?:function\b\s*\*?\s*(?:{_NAME})?\s*(?:<[^>]*>)?\(|class\s+{_NAME}|interface\s+{_NAME}|type\s+{_NAME}(?:<[^>]*>)?\s*=|enum\s+{_NAME}|namespace\s+{_NAME}|(?:const|let|var)\s+[\w$\[{{])|(?:(?:async|static|get|set|public|private|protected|readonly|override)\s+)*[*#]?(?!function\b|if\b|for\b|while\b|switch\b){_NAME}\s*(?:<[^>]*>)?{_ARGS}\s*(?::[^\n{{;]+)?\{{|import\b|export\s*[{{*]|(?:for|while|if|switch)\s*\([^\n]*\{{|(?:throw|return)\b|[\w$.]+\s*(?:=(?!=)|\([^\n]*\)\s*;)|[\"'(;!]"),
}
# Words that begin or stand in definitions of other languages, and cannot stand where a type or a name does.
_BARE_CLASS = r"\s*(?:class|module)\s+\w+(?:\s*<\s*[\w:]+)?[ \t]*\n(?!\s*\{)"
ALIEN = {
    "java": re.compile(rf"\s*(?:export|function|func|fn|def|let|const|async|struct|impl|pub|trait|module|namespace|template|using|auto|size_t|type)\b|[^\n]*::|[^\n]*&|{_BARE_CLASS}|[^\n]*\{{\s*(?:public|private|protected)\s*:"),
    "cpp": re.compile(rf"\s*(?:export|function|func|fn|def|let|async|impl|pub|trait|module|interface|public|private|protected|type|final|record|var)\b|{_BARE_CLASS}"),
    "typescript": re.compile(rf"{_BARE_CLASS}|[^\n]*\{{\s*(?:public|private|protected)\s*:|\s*struct\b"),
    "javascript": re.compile(rf"{_BARE_CLASS}|[^\n]*\{{\s*(?:public|private|protected)\s*:|\s*struct\b"),
    "rust": re.compile(r"\s*type\s+\w+\s+(?:struct|interface)\b"),
}


# Languages whose forms are those of another one here.
FORMS_OF = {"c": "cpp", "tsx": "typescript"}
# A binary operator with nothing behind it that it could take; per language, as some read such pairs otherwise.
_CUT_OFF = re.compile(r"(?<![-+:(,=<>])(?:(?<!\+)\+|(?<!-)-|%|&&|\|\|)\s*[)\]};]")
_TWO_OPERATORS = re.compile(r"[\w)\]]\s*[-+/%]\s*(?:[*%]|/(?![/*=])|==)\s*[\w(\"]")
KINDS = ("merge_conflict", "unterminated_literal", "unbalanced", "premature_end", "bad_syntax", "other_language")
_STATEMENT_HEAD = re.compile(r"\s*(?:@|(?:if|else|for|while|do|switch|case|default|try|catch|finally|class|interface|enum|record|public|private|protected|static|final|abstract|synchronized|package|import|throws|new)\b)")
_GOES_ON = re.compile(r"(?:instanceof|throws|extends|implements|permits|else|catch|finally|while|when)\b")


def _misses_semicolon(text: str, lexed: Lexed) -> bool:
    """Whether a Java statement goes over a line's end where nothing can hold its two lines together."""
    depth, statement = [], ""
    for kind, start, stop in lexed.tokens:
        piece = text[start:stop]
        if kind == "open":
            depth.append(piece)
            statement = "" if piece == "{" else statement + piece
        elif kind == "close":
            depth.pop()
            statement = "" if piece == "}" else statement + piece
        elif kind == "end":
            statement = ""
        elif kind != "comment" and depth and depth[-1] == "{" and "(" not in depth:
            if kind == "text":
                statement += '""'
                continue
            lines = (statement + "\n" * text.count("\n", text.rfind(statement[-1:], 0, start) if statement else start, start) + piece).split("\n")
            for before, after in zip(lines, lines[1:]):
                head = before if before.strip() else ""
                if head and re.search(r"[\w)\]\"]\s*$", head) and re.match(r"\s*[A-Za-z_]", after) and not _GOES_ON.match(after.strip()) and not _STATEMENT_HEAD.match(head) and re.search(r"[=(]", head) and not re.search(r"\b(?:return|throw|yield)$", head.strip()):
                    return True
            statement = lines[-1]
    return False


def unreadable(text: str, language: str) -> str | None:
    """Why ``text`` is no definition and no script of ``language``; None if it can be read as one.

    Besides the faults of the stack: other_language, where the text does not begin like any definition or script of the
    language; premature_end, where it stops behind an operator or, in Python, at the head of a block that never comes;
    bad_syntax, where operators lack an operand or, in Java, a statement its end. What the lexer passes in Python is last
    shown to Python's own parser, an exact check.
    """
    lexed = lex(text, language)
    if lexed.fault:
        return lexed.fault
    code, form = bare(text, lexed).strip(), FORMS_OF.get(language, language)
    if not code:
        return None
    alien = ALIEN.get(form)
    if form in HEADS and (not HEADS[form].match(code) or (alien and alien.match(code))):
        return "other_language"
    if language == "python" and re.match(r"\s*(?:if|elif|while|for|with|def|class)\b[^:\n]*$", code[code.rfind("\n") + 1 :]):
        return "premature_end"
    if code[-1] in "=+-*/%&|^,.<(" or (language == "python" and code[-1] == ":"):
        return None if code.endswith(("++", "--", "*/")) else "premature_end"
    if language in ("java", "javascript", "typescript", "go", "csharp") and (_CUT_OFF.search(code) or (language not in ("go", "csharp") and _TWO_OPERATORS.search(code))):
        return "bad_syntax"
    if language == "java" and _misses_semicolon(text, lexed):
        return "bad_syntax"
    return "bad_syntax" if language == "python" and not _parses(text) else None


def _parses(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(textwrap.dedent(text) if text[:1].isspace() else text)
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return True
    return True
