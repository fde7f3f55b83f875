"""C and C++ declarations by one pass over braces and semicolons.

Comments, literals and preprocessor lines are blanked first (lines stay). What
stands before a `{` or `;` at namespace or class level is a head, which is a
class, a namespace, a function, or nothing of interest. Bodies are skipped.
Not a full grammar: macros that open braces and K&R definitions are not seen. The
body of a function is known by the place of its head; that of a declaration is
the first definition of its name in the file.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

from .places import Places

EXTENSIONS = ("c", "cpp", "cc", "cxx", "h", "hpp", "hxx", "hh")
HEADERS = ("h", "hpp", "hxx", "hh")
MOST_CHARS = 2_000_000

_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|R"(\w*)\(.*?\)\1"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|^[ \t]*#(?:[^\n\\]|\\.|\\\n)*', re.S | re.M)
_CLASS = re.compile(r"^(class|struct)\s+(?:\w+\s+)*?((?:\w+::)*\w+)(?:<[^{}]*>)?\s*(?:final\s*)?(:[^:].*)?$", re.S | re.A)
_SPACE_OPEN = re.compile(r'^(?:inline\s+)?namespace\b|^extern\s*(?:""|$)|^extern\s+$', re.A)
_NAME = re.compile(r"((?:[A-Za-z_]\w*(?:<[^<>]*>)?::)*(?:~?[A-Za-z_]\w*|operator\s*(?:\(\)|\[\]|[^\s\w(]+|[\w:]+\s*[*&]?)))\s*$", re.A)
_LABEL = re.compile(r"^(?:\s*(?:public|private|protected|signals|slots)(?:\s+slots)?\s*:(?!:))+", re.A)
_STORAGE = re.compile(r"\b(?:static|virtual|inline|explicit|extern|friend|constexpr|typedef|register|mutable|thread_local)\b", re.A)
_CONTROL = re.compile(r"^\s*(?:else|if|for|while|switch|catch|return|do|case|throw|new|delete|using)\b", re.A)


def _blank(m: re.Match) -> str:
    kept = '""' if m[0][0] in "\"R'" and len(m[0]) >= 2 else ""
    return kept + "".join("\n" if c == "\n" else " " for c in m[0][len(kept) :])


def _template_end(head: str) -> int:
    depth = 0
    for i, c in enumerate(head):
        depth += (c == "<") - (c == ">")
        if c == ">" and depth == 0:
            return i + 1
    return 0


def _parameters(head: str) -> tuple[int, int] | None:
    """Place of the parameter list: the first parenthesis behind a name, outside template arguments."""
    depth, i = 0, 0
    while i < len(head):
        c = head[i]
        if c == "<" and not head[:i].rstrip().endswith("operator"):
            depth += 1
        elif c == ">" and depth:
            depth -= 1
        elif c == "=" and depth == 0 and not re.search(r"operator\s*\S*$", head[:i]):
            return None
        elif c == "(" and depth == 0:
            if re.search(r"operator\s*$", head[:i]) and head[i : i + 2] == "()":
                i += 2
                continue
            level = 0
            for j in range(i, len(head)):
                level += (head[j] == "(") - (head[j] == ")")
                if level == 0:
                    return i, j + 1
            return None
        i += 1
    return None


def _function(head: str) -> tuple[str, str, int] | None:
    """(name, signature text, place of the name) of a function head: return type, declarator with trailing qualifiers, leading const last."""
    if _CONTROL.match(head):
        return None
    span = _parameters(head)
    if span is None:
        return None
    name = _NAME.search(head[: span[0]])
    if not name:
        return None
    lead = _STORAGE.sub(" ", head[: name.start()])
    quals = re.findall(r"\b(?:const|volatile)\b", re.sub(r"<.*>", "", lead))
    kind = re.sub(r"\b(?:const|volatile)\b(?![^<]*>)", " ", lead).replace("*", " ").replace("&", " ")
    kind = " ".join(kind.split())
    plain = name[1].split("::")[-1]
    owner = name[1].split("::")[-2] if "::" in name[1] else ""
    if not kind and "~" not in plain and "operator" not in plain and owner != plain and not owner:
        quals = []
    rest = head[span[1] :]
    colon = re.search(r"(?<!:):(?!:)", rest)
    rest = " ".join(re.sub(r"=\s*(?:0|default|delete)\s*$", "", rest[: colon.start()] if colon else rest).split())
    if rest and not re.match(r"^(?:const|noexcept|override|final|volatile|&&?|->|throw|\s|\()", rest):
        return None
    text = " ".join(x for x in (kind, name[1] + head[span[0] : span[1]], rest, *quals) if x)
    return name[1], text, name.start(1)


Row = tuple[str, str, str, int | None, int | None]


def declarations(code: str, path: str) -> Iterator[Row]:
    """(raw id, kind, signature, declaration line, implementation line); signatures aren't normalized yet."""
    return (row for row, _, _ in _scan(code, path, None))


def with_bodies(code: str, path: str) -> Iterator[tuple[Row, Callable[[], str | None]]]:
    """The rows of `declarations`, each with a function that gives its body: from the line of its name to the closing brace."""
    if not code or len(code) > MOST_CHARS or "\0" in code:
        return
    clean = _NOISE.sub(_blank, code)  # of the same length
    places, first, rows = Places(clean), {}, []
    for row, name_at, brace in _scan(code, path, clean):
        body = None
        if brace is not None and brace in places.ends:
            body = (clean.rfind("\n", 0, name_at) + 1, places.ends[brace])
            parts = row[0].split("::")
            for k in range(len(parts)):
                first.setdefault("::".join(parts[k:]), body)
        rows.append((row, body))
    for row, body in rows:
        body = body or (first.get(row[0]) if row[1] == "function" else None)
        yield row, lambda body=body: code[slice(*body)].strip() if body else None


def _scan(code: str, path: str, clean: str | None) -> Iterator[tuple[Row, int, int | None]]:
    """Rows with the place of the name and that of the opening brace of a function's body."""
    if not code or len(code) > MOST_CHARS or "\0" in code:
        return
    header = path.rpartition(".")[2].lower() in HEADERS
    code = _NOISE.sub(_blank, code) if clean is None else clean
    breaks = [m.start() for m in re.finditer("\n", code)]
    levels: list[tuple[str, str]] = []
    begin, parens = 0, 0
    for m in re.finditer(r"[{};()]", code):
        c, at = m[0], m.start()
        if c in "()":
            parens = max(0, parens + (1 if c == "(" else -1))
            continue
        if parens and c != "}":
            if c == "{":
                levels.append(("other", ""))
            continue
        parens = 0
        raw = code[begin:at]
        head = _LABEL.sub("", raw)
        lead = len(raw) - len(head) + len(head) - len(head.lstrip())
        head = head.strip()
        if head.startswith("template"):
            cut = _template_end(head)
            lead += cut + len(head[cut:]) - len(head[cut:].lstrip())
            head = head[cut:].strip()
        where, owner = levels[-1] if levels else ("space", "")
        start, begin = begin + lead, at + 1
        line = bisect_left(breaks, start) + 1
        if c == "}":
            if levels:
                levels.pop()
        elif where == "other":
            if c == "{":
                levels.append(("other", ""))
        elif c == "{":
            cls = _CLASS.match(head)
            if cls and "(" not in head:
                name = cls[2].split("::")[-1]
                yield (cls[2], "class", f"{cls[1]} {cls[2]} {cls[3] or ''}", line, None), start, None
                levels.append(("class", name))
            elif _SPACE_OPEN.match(head):
                levels.append(("space", ""))
            else:
                found = _function(head)
                if found:
                    yield (found[0], "function", found[1], line if header else None, line), start + found[2], at
                levels.append(("other", ""))
        else:
            found = _function(head)
            if found:
                name, text, place = found
                if where == "class" and "::" not in name:
                    text = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", lambda _: f"{owner}::{name}", text, count=1)
                    name = f"{owner}::{name}"
                yield (name, "function", text, line, None), start + place, None
