"""Implementation snippets of symbols: by braces, by indentation, or up to `end`."""

from __future__ import annotations

import re

from ..functions.text import SPACE
from .patterns import LANGUAGES

UNCLOSED = 500
_PUNCTUATION = re.compile(r"\s*([(),*&<>:=])\s*")


def _block(code: str, at: int) -> int | None:
    """End of the block whose first brace is at or behind `at`; None if it isn't closed."""
    depth = 0
    for m in re.compile("[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return None


def signature_regex(signature: str) -> str:
    """White space is optional around punctuation and free elsewhere, so a normalized signature finds its source."""
    out = []
    for piece in re.split(r"([(),*&<>:=])", signature):
        if re.fullmatch(r"[(),*&<>:=]", piece):
            out.append(r"\s*" + re.escape(piece) + r"\s*")
        else:
            out.append(r"\s+".join(map(re.escape, piece.split())))
    return "".join(out)


def braces_body(code: str, signature: str) -> str | None:
    m = re.search(signature_regex(signature), code)
    at = code.find("{", m.end()) if m else -1
    if at < 0:
        return None
    end = _block(code, at)
    return code[at : at + UNCLOSED] if end is None else code[at:end]


def cpp_body(code: str, signature: str) -> str | None:
    """From the line of the definition of the signature's last called name to its closing brace."""
    names = re.findall(r"([~A-Za-z_][\w:]*)\s*\(", signature, re.A)
    if not names:
        return None
    name = names[-1]
    for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", code, re.A):
        open_at, depth = code.find("(", m.end()), 0
        if open_at < 0:
            return None
        close = next((x.end() for x in re.compile("[()]").finditer(code, open_at) if (depth := depth + (1 if x[0] == "(" else -1)) == 0), None)
        if close is None:
            return None
        follow = re.compile(r"\s*(?:const\s*)?(?:noexcept\s*)?(?=\{)").match(code, close)
        if follow:
            end = _block(code, follow.end())
            return None if end is None else code[code.rfind("\n", 0, m.start()) + 1 : end].strip()
    return None


def _indent(line: str) -> int:
    return len(re.match(f"[{SPACE}]*", line)[0])


def indent_body(code: str, signature: str) -> str | None:
    name = re.search(r"def\s+(\w+)", signature, re.A)
    m = name and re.search(rf"^(\s*)(?:async\s+)?def\s+{name[1]}\s*\([^)]*\)[^:]*:", code, re.M)
    if not m:
        return None
    kept = []
    for line in code[m.end() :].split("\n"):
        word = line.strip()
        if word and not word.startswith("#") and _indent(line) <= len(m[1]):
            break
        kept.append(line)
    return "\n".join(kept).strip() or None


def end_body(code: str, signature: str) -> str | None:
    name = re.search(r"def\s+(self\.)?(\w+[?!=]?)", signature, re.A)
    m = name and re.search(rf"^(\s*)def\s+{re.escape((name[1] or '') + name[2])}", code, re.M)
    if not m:
        return None
    kept = []
    for line in code[m.start() :].lstrip("\n").split("\n")[1:]:
        if line.strip() == "end" and _indent(line) == len(m[1]):
            break
        kept.append(line)
    return "\n".join(kept).strip() or None


def shell_body(code: str, signature: str) -> str | None:
    name = re.search(r"(\w+)\s*\(\)", signature, re.A)
    m = name and re.search(rf"(?:function\s+)?{name[1]}\s*\(\s*\)\s*\{{", code)
    if not m:
        return None
    end = _block(code, m.end() - 1)
    return code[m.end() : m.end() + UNCLOSED] if end is None else code[m.end() : end - 1].strip()


def implementation(lang: str, code: str, signature: str) -> str | None:
    """Whole snippet of a symbol, or None where it isn't found; only prompts are truncated."""
    if not code or not signature:
        return None
    how = "cpp" if lang == "cpp" else LANGUAGES[lang].body if lang in LANGUAGES else "cpp"
    return {"cpp": cpp_body, "braces": braces_body, "indent": indent_body, "end": end_body, "shell": shell_body}[how](code, signature)
