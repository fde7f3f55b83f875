"""Ignore rules of a source tree, compiled to one regular expression per rule."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ALWAYS = ("node_modules",)


def rule_regex(rule: str) -> tuple[str, bool] | None:
    """Regular expression over relative paths for a gitignore line, and whether it takes paths back in; None for comments."""
    line = rule.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    only_dir = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i:]:
            end = line.index("]", i)
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body.startswith("!") else body) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_dir else "(?:/|$)"), negated


def compiled(rules: Sequence[str]) -> list[tuple[str, bool]]:
    return [r for r in map(rule_regex, (*ALWAYS, *rules)) if r]


def is_ignored(path: str, rules: Sequence[str]) -> bool:
    hit = False
    for regex, negated in compiled(rules):
        if re.search(regex, path):
            hit = not negated
    return hit


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """The same as a column: the last rule that matches a path decides."""
    out = F.lit(False)
    for regex, negated in compiled(rules):
        out = F.when(path.rlike(regex), not negated).otherwise(out)
    return out
