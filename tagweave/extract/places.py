"""Places in a source text, found in one pass: partners of braces, line numbers, and bodies of declarations that are known by their place."""

from __future__ import annotations

import re
from bisect import bisect_left

from ..functions.text import SPACE

UNCLOSED = 500
_WIDTH = re.compile(f"[{SPACE}]*")
_OPEN = re.compile(r"[{;]")
_BLOCK_NEXT = re.compile(rf"[{SPACE}]*\{{")


class Places:
    """Index of a text: the end of the block of each `{`, and line numbers; every lookup is independent of the text's length."""

    def __init__(self, code: str) -> None:
        self.code = code
        self.ends: dict[int, int] = {}
        self.breaks = [m.start() for m in re.finditer("\n", code)]
        waiting: list[int] = []
        for m in re.finditer("[{}]", code):
            if m[0] == "{":
                waiting.append(m.start())
            elif waiting:
                self.ends[waiting.pop()] = m.end()

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def block(self, m: re.Match, arrow: bool = False) -> str | None:
        """The block of a declaration: from its brace, which a `;` mustn't precede, to the partner, or some text if there is none."""
        last = m.end() - 1
        if arrow:
            found = _BLOCK_NEXT.match(self.code, m.end())
            at = found.end() - 1 if found else -1
        elif self.code[last] in "{;":
            at = last
        else:
            found = _OPEN.search(self.code, m.end())
            at = found.start() if found else -1
        if at < 0 or self.code[at] == ";":
            return None
        return self.code[at : self.ends.get(at, at + UNCLOSED)]

    def shell(self, m: re.Match) -> str:
        """What stands in the braces of a shell function, of which the match takes in the first."""
        end = self.ends.get(m.end() - 1)
        return self.code[m.end() : m.end() + UNCLOSED] if end is None else self.code[m.end() : end - 1].strip()

    def deeper(self, m: re.Match) -> str | None:
        """The rest of the line and the lines after it that are blank, comments, or indented more than the declaration."""
        code, at = self.code, m.end()
        indent = len(m[1].rpartition("\n")[2])
        line = self.line(at) - 1
        stop = len(code)
        while line < len(self.breaks):
            start = self.breaks[line] + 1
            width = _WIDTH.match(code, start).end() - start  # may run on over blank lines
            line += 1
            end = self.breaks[line] if line < len(self.breaks) else len(code)
            if start + width >= end or code[start + width] == "#":
                continue
            if width <= indent:
                stop = start
                break
        return code[at:stop].strip() or None

    def until_end(self, m: re.Match) -> str | None:
        """The lines after the declaration's up to an `end` with its indentation."""
        code, indent = self.code, len(m[1].rpartition("\n")[2])
        line = bisect_left(self.breaks, m.end())
        begin = self.breaks[line] + 1 if line < len(self.breaks) else len(code)
        stop = len(code)
        while line < len(self.breaks):
            start = self.breaks[line] + 1
            line += 1
            end = self.breaks[line] if line < len(self.breaks) else len(code)
            if code.startswith("end", start + indent) and _WIDTH.match(code, start).end() == start + indent and not code[start + indent + 3 : end].strip():
                stop = start
                break
        return code[begin:stop].strip() or None
