"""Column builders for strings, tags, signatures and snippets: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import HARD_ALIASES, SEMANTIC_STOP_WORDS, STOP_WORDS

#: White space of the source language's regular expressions; Java's \s lacks the no-break spaces.
SPACE = r"\s   -     　﻿"
CJK = r"一-鿿"


def strip(c: Column) -> Column:
    """Trim by SPACE, which the built-in trim doesn't cover."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# --- files, signatures, ids -------------------------------------------------------------------


def file_hash(content: Column) -> Column:
    return F.sha1(content)


def normalize_signature(signature: Column) -> Column:
    one = F.regexp_replace(signature, rf"[{SPACE}]+", " ")
    return F.trim(F.regexp_replace(one, r" *([(),*&<>:=]) *", "$1"))


def hash_signature(signature: Column) -> Column:
    return F.sha1(normalize_signature(signature))


def impl_hash(signature: Column, snippet: Column) -> Column:
    """Over the whole snippet, so that an edit anywhere in a long body is seen."""
    return F.sha1(F.concat(signature, F.lit("\n"), F.coalesce(snippet, F.lit(""))))


def id_parts(symbol: Column) -> Column:
    return F.filter(F.split(symbol, "::"), lambda p: p != "")


def symbol_id(hint: Column, raw: Column) -> Column:
    return F.concat(hint, F.lit("::"), raw)


def symbol_key(hint: Column, raw: Column) -> Column:
    parts = id_parts(raw)
    return F.concat(hint, F.lit("::"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "::"))


def qualifier_depth(raw: Column) -> Column:
    return F.size(id_parts(raw))


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def extension_priority(path: Column) -> Column:
    return F.when(extension_of(path).isin("cpp", "cc", "cxx", "c"), 0).otherwise(1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def module_hint_cpp(path: Column) -> Column:
    """Segment behind `src`, else the first one; a file name loses its extension."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    at = F.array_position(parts, "src").cast("int")
    pick = F.when((at > 0) & (at < F.size(parts)), F.element_at(parts, F.greatest(at + 1, F.lit(1)))).otherwise(F.element_at(parts, 1))
    return F.coalesce(F.nullif(_stem(pick), F.lit("")), F.lit("core"))


def module_hint(path: Column) -> Column:
    """Last two directories but for the usual source folders, else the file's stem; `.` at the root."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    dirs = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: (p != "") & ~p.isin("src", "lib", "app", "pkg", "cmd", "internal"))
    joined = F.array_join(F.slice(dirs, F.greatest(F.size(dirs) - 1, F.lit(1)), 2), "/")
    return F.when(F.size(parts) == 1, ".").when(F.size(dirs) > 0, joined).otherwise(_stem(F.element_at(parts, -1)))


def module_name(path: Column) -> Column:
    return F.coalesce(F.nullif(_stem(F.regexp_extract(path, r"([^/\\]*)$", 1)), F.lit("")), F.lit("core"))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def title_from_id(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "Core").otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30)))


def display_line(decl: Column, impl: Column) -> Column:
    return F.coalesce(F.nullif(decl, F.lit(0)), impl)


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


# --- tags ------------------------------------------------------------------------------------


def clean_tag(tag: Column) -> Column:
    """Normalization on the write path: trimmed and lower-cased."""
    return F.lower(strip(tag))


def query_tag(tag: Column) -> Column:
    """Normalization on the query path: no stop words and no aliases."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(clean_tag(tag), rf"[{SPACE}\-.]+", "_"), r"_+", "_"), r"^_+|_+$", "")


def alias_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in HARD_ALIASES.items() for x in pair])


def bound(value: Column, body) -> Column:
    """body(value), with the value evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _index_form(t: Column) -> Column:
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, rf"[{SPACE}\-.]+", "_"), r"_+", "_"), r"^_|_$", "")
    for left, right in ((CJK, CJK), ("a-z0-9", CJK), (CJK, "a-z0-9")):
        u = F.regexp_replace(u, rf"([{left}])_+([{right}])", "$1$2")
    return F.regexp_replace(u, rf"[^a-z0-9_{CJK}]", "")


def index_tag(tag: Column) -> Column:
    """Normalization of a new tag; null where the tag is dropped."""
    alias = lambda u: bound(F.coalesce(F.element_at(alias_map(), u), u), lambda out: F.when(F.length(out) >= 2, out))
    keep = lambda u: F.when((F.length(u) >= 2) & ~u.isin(*STOP_WORDS) & (u != "constructor"), alias(u))
    return bound(clean_tag(tag), lambda t: F.when(F.length(t) >= 2, bound(_index_form(t), keep)))


def index_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, index_tag), lambda t: t.isNotNull()))


def unified_tags(*arrays: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.concat(*[F.coalesce(a, strings()) for a in arrays]), clean_tag), lambda t: t != ""))


def split_camel(c: Column) -> Column:
    parts = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), rf"[_\-{SPACE}]+", " ")
    return F.filter(F.split(parts, " "), lambda p: p != "")


def split_camel_plain(c: Column) -> Column:
    """Camel case, underscores and hyphens; white space stays."""
    return F.filter(F.split(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), r"[_\-]+"), lambda p: F.trim(p) != "")


def split_snake(c: Column) -> Column:
    return F.filter(F.split(c, r"[_\-]+"), lambda p: p != "")


def tokens(parts: Column, least: int, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-cased, trimmed parts of a length that aren't stop words."""
    low = F.transform(parts, clean_tag)
    return F.filter(low, lambda p: (F.length(p) >= least) & ~p.isin(*stop_words)) if stop_words else F.filter(low, lambda p: F.length(p) >= least)


def low_info_tags(base_tags: Column, path: Column, raw_id: Column) -> Column:
    parts = F.flatten(F.transform(F.concat(F.split(_stem(path), r"[/\\]+"), F.split(raw_id, r"::|\.")), split_camel))
    return F.array_union(F.transform(base_tags, clean_tag), F.transform(parts, clean_tag))


def semantic_tags(tags: Column, low_info: Column) -> Column:
    kept = F.filter(F.transform(tags, clean_tag), lambda t: (F.length(t) >= 3) & ~t.isin(*SEMANTIC_STOP_WORDS))
    return F.array_except(F.array_distinct(kept), low_info)


# --- search helpers ----------------------------------------------------------------------------


def tag_matches(query: Column, tag: Column) -> Column:
    """Equal if either has at most three characters, else one contains the other."""
    short = F.least(F.length(query), F.length(tag)) <= 3
    return F.when((query == "") | (tag == ""), False).when(short, query == tag).otherwise(F.contains(tag, query) | F.contains(query, tag))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; none of an empty needle."""
    return F.when(needle == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.greatest(F.length(needle), F.lit(1))).cast("int"))


def doc_title(text: Column, path: Column) -> Column:
    line = F.substring_index(text, "\n", 1)
    return F.when(F.startswith(line, F.lit("# ")), F.trim(F.substring(line, 3, 1 << 30))).otherwise(path)


def preview(text: Column, size: int = 240) -> Column:
    return F.left(text, F.lit(size))


def label(text: Column) -> Column:
    return F.when(F.length(text) > 14, F.concat(F.left(text, F.lit(12)), F.lit("…"))).otherwise(text)


# --- snippets ----------------------------------------------------------------------------------

TRUNCATED = "// ... truncated ..."
NOTHING = "空返回"
MEMBER = "返回成员变量"
SIMPLE = "简单返回"


def braces(text: Column) -> Column:
    """From the first { to the last }; null without such a part."""
    start, back = F.instr(text, "{"), F.instr(F.reverse(text), "}")
    end = F.length(text) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substr(text, start, end - start + 1))


def strip_comments(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"(?m)//.*$", " "), r"(?m)#.*$", " ")


def implementation_body(code: Column) -> Column:
    block = braces(code)
    return F.when(block.isNotNull(), F.substr(block, F.lit(2), F.length(block) - 2)).otherwise(code)


def _bare(code: Column) -> Column:
    return strip(F.regexp_replace(strip_comments(implementation_body(code)), rf"[{SPACE}]+", " "))


_EMPTY = r"""(?i)^return *;? *$|^return *(\{\}|\[\]|null|nullptr|undefined|none|nil|std::nullopt|""|'') *;? *$"""


def trivial_brief(code: Column) -> Column:
    """Brief of a body that needs no model: empty, a member, or a plain value; null for any other."""
    bare = _bare(code)
    value = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^return +", ""), r"; *$", ""))
    plain = bare.rlike(r"^return ") & (value != "") & ~F.regexp_replace(value, "->", "").rlike(r"[^A-Za-z0-9_$.]")
    member = F.contains(value, F.lit("this.")) | F.contains(value, F.lit("this->")) | value.rlike(r"^(_|m_)[A-Za-z0-9_]+$")
    return F.when(F.coalesce(code, F.lit("")) == "", None).when((bare == "") | bare.rlike(_EMPTY), NOTHING).when(plain & member, MEMBER).when(plain, SIMPLE)


def trivial_tags(brief: Column) -> Column:
    return F.when(brief == NOTHING, strings(NOTHING)).when(brief == MEMBER, strings("成员变量访问", "只读访问")).when(brief == SIMPLE, strings(SIMPLE))


def adjusted_tags(code: Column, tags: Column) -> Column:
    """Tags of a model, replaced if the body is empty."""
    return F.when(trivial_brief(code) == NOTHING, strings(NOTHING)).otherwise(tags)


def model_tags(raw: Column) -> Column:
    """Tags in a model's answer when it is one string with whatever separators."""
    text = strip(raw)
    lists = F.split(text, rf"[,\n\r，;；|、{SPACE}]+")
    cjk = F.split(text, "_+")
    parts = F.when(text.rlike(r"[,\n\r，;；|、]"), lists).when(text.rlike(f"[{CJK}]") & F.contains(text, F.lit("_")), cjk).otherwise(F.split(text, rf"[{SPACE}]+"))
    return F.array_distinct(F.filter(F.transform(parts, clean_tag), lambda t: t != ""))


def truncated(code: Column, lines: int = 200, chars: int = 12000) -> Column:
    """A long snippet's first 40 %, middle 20 % and last 40 % of the budget, by lines, then by characters."""
    rows = F.split(code, "\n")
    budget = lines - 2
    head, mid = int(budget * 0.4), int(budget * 0.2)
    n = F.size(rows)
    tail = F.greatest(F.lit(head + mid), n - (budget - head - mid))
    start = F.floor((n - mid) / 2).cast("int")
    start = F.greatest(F.lit(head), F.least(F.greatest(start, F.lit(head)), tail - mid))
    gap = strings(TRUNCATED)
    sampled = F.array_join(F.concat(F.slice(rows, 1, head), gap, F.slice(rows, start + 1, F.lit(mid)), gap, F.slice(rows, tail + 1, F.greatest(n - tail, F.lit(0)))), "\n")
    by_line = F.when(n > lines, sampled).otherwise(code)
    marker = f"\n{TRUNCATED}\n"
    budget = chars - 2 * len(marker)
    head, mid = int(budget * 0.4), int(budget * 0.2)
    n = F.length(by_line)
    start = F.greatest(F.floor((n - mid) / 2).cast("int"), F.lit(head))
    tail = F.greatest(start + mid, n - (budget - head - mid))
    cut = F.concat(F.left(by_line, F.lit(head)), F.lit(marker), F.substr(by_line, start + 1, F.lit(mid)), F.lit(marker), F.substr(by_line, tail + 1, F.greatest(n - tail, F.lit(0))))
    return F.when(n > chars, cut).otherwise(by_line)


def filled_prompt(template: Column, module: Column, signature: Column, implementation: Column) -> Column:
    out = template
    for name, value in (("moduleName", module), ("signature", signature), ("implementation", implementation)):
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def aggregation_groups(answer: Column) -> Column:
    """map<canonical, tags> in a model's answer: `groups`, `mappings` inverted, or the bare map; null if there is none."""
    body = braces(answer)
    lists = "map<string,array<string>>"
    groups = F.from_json(F.get_json_object(body, "$.groups"), lists)
    pairs = F.from_json(F.get_json_object(body, "$.mappings"), "map<string,string>")
    names = F.array_distinct(F.filter(F.transform(F.map_values(pairs), lambda n: F.trim(n)), lambda n: n != ""))
    inverted = F.map_from_arrays(names, F.transform(names, lambda n: F.array_distinct(F.transform(F.filter(F.map_entries(pairs), lambda e: F.trim(e.value) == n), lambda e: F.trim(e.key)))))
    bare = F.from_json(body, lists)
    picked = F.when(F.get_json_object(body, "$.groups").isNotNull(), groups).when(F.get_json_object(body, "$.mappings").isNotNull(), inverted).otherwise(bare)
    clean = F.map_filter(F.transform_values(picked, lambda k, v: F.array_distinct(F.filter(F.transform(v, lambda t: F.trim(t)), lambda t: t != ""))), lambda k, v: (F.trim(k) != "") & (F.size(v) > 0))
    return F.when(F.size(clean) > 0, clean)


def is_placeholder(groups: Column) -> Column:
    return F.forall(F.map_keys(groups), lambda k: F.lower(k).isin("category", "categories", "other", "misc"))


def invalid_signature(signature: Column) -> Column:
    return (signature == "") | signature.rlike(r"[{}]|^\s*(else|if|for|while|switch|catch)\b|\belse\s+if\b")


def script_body(html: Column) -> Column:
    found = F.regexp_extract(html, r"<script[^>]*>([\s\S]*?)</script>", 1)
    return F.when(html.rlike(r"<script[^>]*>[\s\S]*?</script>"), found).otherwise(html)


def parseable(content: Column) -> Column:
    """Not empty, at most two million characters, no NUL."""
    return (F.length(content) > 0) & (F.length(content) <= 2_000_000) & ~F.contains(content, F.lit("\0"))
