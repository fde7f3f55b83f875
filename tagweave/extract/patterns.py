"""Declarations of nine languages as patterns: what is a symbol, its id and its signature.

A rule is a pattern over the whole text with a function from a match to (raw id,
signature). White space in patterns is that of the source language (`white`). The line of a symbol counts the line breaks before the match, which
includes leading blank lines.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.text import SPACE
from .places import Places

_WHITE = re.compile(f"[{SPACE}]+")


def white(pattern: str) -> str:
    """A pattern whose white-space class also has the no-break and typographic spaces, in and outside brackets."""
    out, inside = [], False
    for piece in re.split(r"(\\.|[\[\]])", pattern):
        out.append((SPACE if inside else f"[{SPACE}]") if piece == r"\s" else piece)
        inside = piece == "[" or (inside and piece != "]")
    return "".join(out)


def joined(*parts: str | None) -> str:
    return " ".join(p for p in parts if p)


def flat(text: str) -> str:
    return _WHITE.sub(" ", text.strip())


@dataclass
class Rule:
    """kind, pattern, and (match, text, scope) -> (raw id, signature)."""

    kind: str
    pattern: str
    build: Callable[[re.Match, str, str], tuple[str, str]]
    regex: re.Pattern = field(init=False)

    def __post_init__(self):
        self.regex = re.compile(white(self.pattern), re.M | re.A)


@dataclass
class Language:
    name: str
    extensions: tuple[str, ...]
    rules: tuple[Rule, ...]
    scope: str = ""  # pattern whose first group is the package or namespace
    body: str = "braces"

    def symbols(self, code: str, path: str) -> Iterator[tuple[str, str, str, int]]:
        """(raw id, kind, signature, line) of all declarations, rule by rule."""
        return (row for row, _ in self.with_bodies(code, path))

    def with_bodies(self, code: str, path: str) -> Iterator[tuple[tuple[str, str, str, int], Callable[[], str | None]]]:
        """The rows of `symbols`, each with a function that gives the body of this very declaration."""
        if not code:
            return
        code = self.source(code, path)
        found = re.search(white(self.scope), code, re.M | re.A) if self.scope else None
        scope = found[1] if found else ""
        places = Places(code)
        for rule in self.rules:
            for m in rule.regex.finditer(code):
                raw, signature = rule.build(m, code, scope)
                yield (raw, rule.kind, signature, places.line(m.start())), lambda rule=rule, m=m: self.body_of(places, rule, m)

    def body_of(self, places: Places, rule: Rule, m: re.Match) -> str | None:
        if self.body == "braces":
            return places.block(m, arrow=rule.build is _js_arrow)
        if rule.kind != "function":
            return None
        return {"indent": places.deeper, "end": places.until_end, "shell": places.shell}[self.body](m)

    def source(self, code: str, path: str) -> str:
        return code


def scoped(separator: str = "."):
    return lambda scope, *names: separator.join(n for n in (scope, *names) if n)


_dot, _back = scoped("."), scoped("\\")

_ENCLOSING = {name: re.compile(white(p), re.M | re.A) for name, p in {"python": r"^(\s*)class\s+(\w+)", "ruby": r"^(\s*)(?:class|module)\s+(\w+)"}.items()}


@lru_cache(1)
def _types(language: str, code: str) -> list[tuple[int, int, str, int]]:
    """(end, indentation, name, number of the last type before with less indentation or -1) of all types, in order."""
    out: list[tuple[int, int, str, int]] = []
    for m in _ENCLOSING[language].finditer(code):
        outer = len(out) - 1
        while outer >= 0 and out[outer][1] >= len(m[1]):
            outer = out[outer][3]
        out.append((m.end(), len(m[1]), m[2], outer))
    return out


def enclosing(language: str, code: str, at: int, indent: str) -> str:
    """Name of the last type before `at` that is indented less."""
    types = _types(language, code)
    i = bisect_right(types, at, key=lambda x: x[0]) - 1
    while i >= 0 and types[i][1] >= len(indent):
        i = types[i][3]
    return types[i][2] if i >= 0 else ""


def decorators(code: str, at: int) -> list[str]:
    """Lines with @ directly before a definition, but for blank lines and comments."""
    lines: list[str] = []
    while at >= 0:
        start = code.rfind("\n", 0, at) + 1
        word = code[start:at].strip()
        if word.startswith("@"):
            lines.append(word)
        elif word and not word.startswith("#"):
            break
        at = start - 1
    return lines[::-1]


# --- Java ---

_JAVA_TYPE = re.compile(white(r"(?=(?:class|interface)\s+(\w+))"), re.A)


@lru_cache(1)
def _java_types(code: str) -> tuple[list[tuple[int, str]], list[int]]:
    """(first brace behind the name, name) of all types, and the places of all closing braces, both in order."""
    opens, closes = ([m.start() for m in re.finditer(c, code)] for c in "{}")
    types = []
    for m in _JAVA_TYPE.finditer(code):
        k = bisect_right(opens, m.end(1))
        if k < len(opens):
            types.append((opens[k], m[1]))
    return types, closes


def _java_owner(code: str, at: int) -> str:
    """The first type whose opening brace stands before `at` without a closing brace between."""
    types, closes = _java_types(code)
    k = bisect_right(closes, at - 1) - 1
    i = bisect_right(types, closes[k] if k >= 0 else -1, key=lambda x: x[0])
    return types[i][1] if i < len(types) and types[i][0] < at else ""


def _java_class(m, code, scope):
    signature = joined(m[1].strip(), m[2], m[3], m[4] and f"extends {m[4]}", m[5] and f"implements {m[5].strip()}")
    return _dot(scope, m[3]), signature


def _java_method(m, code, scope):
    return _dot(scope, _java_owner(code, m.start()), m[3]), flat(f"{m[1].strip()} {m[2]} {m[3]}({m[4].strip()})")


# --- JavaScript, TypeScript, Vue ---


def _js_class(m, code, scope):
    return m[4], joined(m[1] and "export", m[2] and "default", m[3] and "abstract", "class", m[4], m[5] and f"extends {m[5]}")


def _js_function(m, code, scope):
    return m[5], joined(m[1] and "export", m[2] and "default", m[3] and "async", "function", m[4] and "*", f"{m[5]}({m[6].strip()})")


def _js_arrow(m, code, scope):
    return m[3], joined(m[1] and "export", m[2], m[3], "=", m[4] and "async", "() => ...")


# --- the others ---


def _python_def(m, code, scope):
    signature = joined(m[2] and "async", f"def {m[3]}({m[4].strip()})", m[5] and m[5].strip() and f"-> {m[5].strip()}")
    return _dot(enclosing("python", code, m.start(), m[1]), m[3]), "\n".join([*decorators(code, m.start()), signature])


def _go_func(m, code, scope):
    result = m[5].strip() if m[5] else ""
    signature = joined("func", m[2] and f"({m[1]} *{m[2]})", f"{m[3]}({m[4].strip()})", f"({result})" if result else m[6])
    return _dot(scope, m[2], m[3]), signature


def _rust_fn(m, code, scope):
    return m[3], joined(m[1] and "pub", m[2] and "async", f"fn {m[3]}{m[4] or ''}({m[5].strip()})", m[6] and m[6].strip() and f"-> {m[6].strip()}")


def _ruby_def(m, code, scope):
    owner = enclosing("ruby", code, m.start(), m[1])
    return "::".join(n for n in (owner, m[3]) if n), f"def {'self.' if m[2] else ''}{m[3]}({(m[4] or '').strip()})"


class Script(Language):
    """JavaScript family; of a Vue file the first script element counts."""

    def source(self, code: str, path: str) -> str:
        if path.lower().endswith(".vue"):
            m = re.search(r"<script[^>]*>([\s\S]*?)</script>", code)
            return m[1] if m else code
        return code

    def with_bodies(self, code, path):
        yield from super().with_bodies(code, path)
        if path.lower().endswith(".vue") and code and re.search(r"export\s+default\s+", self.source(code, path)):
            name = re.split(r"[/\\]", path)[-1][: -len(".vue")]
            yield (name, "class", f"Vue Component: {name}", 1), lambda: None


# The declaration patterns decide which symbols there are.
LANGUAGES: dict[str, Language] = {
    x.name: x
    for x in (
        Language("java", ("java",), scope=r"^\s*package\s+([\w.]+)\s*;", rules=(
            Rule("class", r"^\s*((?:public|private|protected|abstract|final|static|\s)*)(class|interface|enum)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?\s*\{?", _java_class),
            Rule("function", r"^\s*((?:public|private|protected|static|final|abstract|synchronized|native|\s)*)\s*(?:<[\w,\s?]+>\s*)?(\w+(?:<[\w,\s?]+>)?)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s]+)?\s*[{;]", _java_method),
        )),
        Script("js", ("js", "jsx", "ts", "tsx", "mjs", "cjs", "vue"), rules=(
            Rule("class", r"^\s*(export\s+)?(default\s+)?(abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+[\w,\s]+)?\s*\{", _js_class),
            Rule("function", r"^\s*(export\s+)?(default\s+)?(async\s+)?function\s*(\*)?\s*(\w+)\s*\(([^)]*)\)", _js_function),
            Rule("function", r"^\s*(export\s+)?(const|let|var)\s+(\w+)\s*=\s*(async\s*)?\([^)]*\)\s*=>", _js_arrow),
        )),
        Language("python", ("py", "pyw"), body="indent", rules=(
            Rule("class", r"^\s*class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:", lambda m, c, s: (m[1], f"class {m[1]}" + (f"({m[2]})" if m[2] else ""))),
            Rule("function", r"^(\s*)(async\s+)?def\s+(\w+)\s*\(([^)]*)\)\s*(?:->([^:]+))?\s*:", _python_def),
        )),
        Language("go", ("go",), scope=r"^package\s+(\w+)", rules=(
            Rule("class", r"^type\s+(\w+)\s+struct\s*\{", lambda m, c, s: (_dot(s, m[1]), f"type {m[1]} struct")),
            Rule("class", r"^type\s+(\w+)\s+interface\s*\{", lambda m, c, s: (_dot(s, m[1]), f"type {m[1]} interface")),
            Rule("function", r"^func\s+(?:\((\w+)\s+\*?(\w+)\)\s+)?(\w+)\s*\(([^)]*)\)(?:\s*\(([^)]*)\)|\s*(\w+))?\s*\{", _go_func),
        )),
        Language("rust", ("rs",), rules=(
            *(Rule("class", rf"^\s*(pub\s+)?{word}\s+(\w+)", lambda m, c, s, word=word: (m[2], joined(m[1] and "pub", word, m[2]))) for word in ("struct", "enum", "trait")),
            Rule("function", r"^\s*(pub\s+)?(async\s+)?fn\s+(\w+)\s*(<[^>]*>)?\s*\(([^)]*)\)(?:\s*->\s*([^\{]+))?\s*\{", _rust_fn),
        )),
        Language("ruby", ("rb", "rake"), body="end", rules=(
            Rule("class", r"^\s*class\s+(\w+)(?:\s*<\s*(\w+))?\s*$", lambda m, c, s: (m[1], joined("class", m[1], m[2] and f"< {m[2]}"))),
            Rule("class", r"^\s*module\s+(\w+)\s*$", lambda m, c, s: (m[1], f"module {m[1]}")),
            Rule("function", r"^(\s*)def\s+(self\.)?(\w+[?!=]?)\s*(?:\(([^)]*)\))?\s*$", _ruby_def),
        )),
        Language("php", ("php",), scope=r"namespace\s+([\w\\]+)\s*;", rules=(
            Rule("class", r"^\s*((?:abstract|final|\s)*)(class|interface|trait)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([^\{]+))?\s*\{", lambda m, c, s: (_back(s, m[3]), joined(flat(f"{m[1]} {m[2]} {m[3]}"), m[4] and f"extends {m[4]}", m[5] and f"implements {m[5].strip()}"))),
            Rule("function", r"^\s*((?:public|private|protected|static|final|abstract|\s)*)\s*function\s+(\w+)\s*\(([^)]*)\)(?:\s*:\s*(\??\w+))?\s*[{;]", lambda m, c, s: (m[2], flat(f"{m[1]} function {m[2]}({m[3].strip()})") + (f": {m[4]}" if m[4] else ""))),
        )),
        Language("csharp", ("cs",), scope=r"namespace\s+([\w.]+)", rules=(
            Rule("class", r"^\s*((?:public|private|protected|internal|abstract|sealed|static|partial|\s)*)(class|interface|struct|enum)\s+(\w+)(?:\s*:\s*([^\{]+))?\s*\{", lambda m, c, s: (_dot(s, m[3]), joined(flat(f"{m[1]} {m[2]} {m[3]}"), m[4] and m[4].strip() and f": {m[4].strip()}"))),
            Rule("function", r"^\s*((?:public|private|protected|internal|static|virtual|override|abstract|async|\s)*)\s*(\w+(?:<[\w,\s]+>)?)\s+(\w+)\s*\(([^)]*)\)\s*[{;]", lambda m, c, s: (m[3], flat(f"{m[1]} {m[2]} {m[3]}({m[4].strip()})"))),
        )),
        Language("bash", ("sh", "bash", "zsh"), body="shell", rules=(
            Rule("function", r"^\s*(function\s+)?(\w+)\s*\(\s*\)\s*\{", lambda m, c, s: (m[2], joined(m[1] and "function", f"{m[2]}()"))),
        )),
    )
}
