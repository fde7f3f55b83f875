"""Base tags of symbols as native expressions, driven by what differs between languages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .vocabulary import BASE_STOP_WORDS


@dataclass(frozen=True)
class Style:
    """How a language's ids are cut, which words of a signature are tags, and where supertypes stand."""

    separator: str = r"\."
    split: str = "camel"
    owner: str = "capital"  # "capital": the last but one part, if it starts with a capital; "any"; "none"
    skip_files: str = ""
    skip_parts: str = ""
    flags: tuple[tuple[str, str], ...] = ()
    supers: tuple[tuple[str, int, bool], ...] = ()  # pattern, least length, whether the parts are tags too
    marks: str = ""  # pattern of annotations
    unmarked: tuple[str, ...] = ()
    always: tuple[str, ...] = ()


def words(*names: str) -> tuple[tuple[str, str], ...]:
    return tuple((rf"\b{n}\b", n) for n in names)


STYLES: dict[str, Style] = {
    "cpp": Style("::", owner="any", flags=((r"^class\b", "class"), (r"^struct\b", "struct"))),
    "java": Style(flags=words("class", "interface", "enum", "abstract", "static"), supers=((r"\bextends\s+(\w+)", 1, True), (r"\bimplements\s+([\w,\s]+)", 1, True)), marks=r"@(\w+)"),
    "js": Style(flags=(*words("class", "function", "async", "export", "default"), (r"(?s)\bconst\b.*=>|=>.*\bconst\b", "arrow")), supers=((r"\bextends\s+(\w+)", 1, True),), marks=r"@(\w+)"),
    "python": Style(
        skip_files=r"^__init__$", skip_parts="__init__",
        flags=((r"\bclass\b", "class"), (r"\bdef\b", "function"), (r"\basync\s+def\b", "async"), (r"\b__init__\b", "constructor"), (r"\b__\w+__\b", "dunder"), (r"\bself\b", "method"), (r"\bcls\b", "classmethod")),
        supers=((r"class\s+\w+\s*\(([^)]+)\)", 1, True),), marks=r"@(\w+)", unmarked=("staticmethod", "classmethod", "property"),
    ),
    "go": Style(skip_files=r"^main$|_test$", flags=((r"\bfunc\b", "func"), (r"\btype\s+\w+\s+struct\b", "struct"), (r"\btype\s+\w+\s+interface\b", "interface"), (r"\bpackage\b", "package"), (r"\bfunc\s+(?:\([^)]+\)\s+)?[A-Z]", "exported"), (r"\bfunc\s+\(\w+\s+\*?\w+\)", "method")), supers=((r"\bfunc\s+\(\w+\s+\*?(\w+)\)", 1, True),)),
    "rust": Style("::", "snake", "none", skip_files=r"^(mod|lib|main)$", flags=(*words("struct", "enum", "trait", "impl"), (r"\bfn\b", "function"), *words("async"), (r"\bpub\b", "public"), *words("unsafe")), supers=((r"impl\s+(\w+)\s+for\s+\w+", 1, False), (r"impl\s+\w+\s+for\s+(\w+)", 1, False), (r"#\[derive\(([^)]+)\)\]", 3, False))),
    "ruby": Style("::", "snake", "none", flags=(*words("class", "module"), (r"\bdef\b", "method"), (r"\bself\.\w+", "classmethod"), *words("private", "protected"), (r"\b(has_many|belongs_to|has_one)\b", "association"), (r"\bvalidates\b", "validation"), (r"\b(before_action|after_action)\b", "callback")), supers=((r"class\s+\w+\s*<\s*(\w+)", 1, False),)),
    "php": Style(r"\\", "plain", "none", flags=words("class", "interface", "trait", "abstract", "static"), supers=((r"extends\s+(\w+)", 1, False), (r"implements\s+([\w,\s\\]+)", 3, False))),
    "csharp": Style(split="plain", flags=words("class", "interface", "struct", "enum", "abstract", "static", "async"), supers=((r":\s*(\w+)", 1, False),), marks=r"\[(\w+)"),
    "bash": Style(r"[_\-]+", "none", "none", flags=words("function", "export", "local"), always=("shell", "script")),
}
SPLIT = {"camel": X.split_camel, "plain": X.split_camel_plain, "snake": X.split_snake, "none": lambda c: F.array(c)}


def base_tags(lang: str, symbol: Column, signature: Column, path: Column, hint: Column) -> Column:
    """Distinct base tags of a symbol of one language, in order: module, folders, file, id, owner, keywords, supertypes, marks."""
    style, stop, none = STYLES[lang], BASE_STOP_WORDS[lang], X.strings()
    split = SPLIT[style.split]
    file = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    folder = F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")
    file_split = X.split_snake(file) if style.split == "none" else split(file)
    found = [X.strings(*style.always), X.tokens(F.split(hint, r"[\\/]+"), 2, stop), X.tokens(F.split(folder, r"[\\/]+"), 2, stop)]
    own = X.tokens(file_split, 2, stop)
    found.append(F.when(file.rlike(style.skip_files), none).otherwise(own) if style.skip_files else own)
    if lang == "js":
        ext = X.extension_of(path)
        found += [F.when(ext == "vue", X.strings("vue", "component")).otherwise(none), F.when(ext.isin("tsx", "jsx"), X.strings("jsx", "component")).otherwise(none), F.when(ext.isin("ts", "tsx"), X.strings("typescript")).otherwise(none)]
    parts = F.split(symbol, style.separator)
    named = F.filter(parts, lambda p: p != style.skip_parts) if style.skip_parts else parts
    found.append(X.tokens(F.flatten(F.transform(named, split)), 3, stop))
    owner = F.try_element_at(parts, F.lit(-2))
    if style.owner == "any":
        found.append(F.when(F.coalesce(owner, F.lit("")) != "", F.concat(F.array(F.lower(owner)), X.tokens(split(owner), 2))).otherwise(none))
    elif style.owner == "capital":
        found.append(F.when(owner.rlike("^[A-Z]"), F.array(F.lower(owner))).otherwise(none))
    found += [F.when(signature.rlike(p), X.strings(t)).otherwise(none) for p, t in style.flags]
    if lang == "cpp":
        last = F.element_at(parts, -1)
        bases = F.filter(F.transform(F.split(F.regexp_extract(signature, r"(?s)^[^:]*:([^{]*)", 1), ","), lambda b: F.trim(F.regexp_replace(b, r"\b(public|private|protected|virtual|final)\b", ""))), lambda b: b != "")
        supers = F.flatten(F.transform(bases, lambda b: F.concat(F.array(F.lower(F.element_at(F.split(b, "::"), -1))), F.flatten(F.transform(F.split(b, "::"), lambda p: X.tokens(X.split_camel(p), 2))))))
        found.append(F.when(signature.rlike(r"^(class|struct)\b"), F.concat(F.array(F.lower(last)), X.tokens(X.split_camel(last), 2), supers)).otherwise(none))
    for pattern, least, with_parts in style.supers:
        names = F.transform(F.split(F.regexp_extract(signature, pattern, 1), ","), lambda n: F.element_at(F.split(F.trim(n), r"[.\\]"), -1))
        found.append(F.flatten(F.transform(_long(names, least), _named(split) if with_parts else lambda n: F.array(F.lower(n)))))
    if style.marks:
        marks = F.transform(F.regexp_extract_all(signature, F.lit(style.marks), F.lit(1)), F.lower)
        found.append(F.filter(marks, lambda m: (F.length(m) >= 3) & ~m.isin(*style.unmarked)) if style.unmarked else F.filter(marks, lambda m: F.length(m) >= 3))
    return F.array_distinct(F.concat(*found))


def _long(names: Column, least: int) -> Column:
    return F.filter(names, lambda n: (F.length(n) >= least) & (n != "object"))


def _named(split):
    """A name in lower case, and its parts."""
    return lambda n: F.concat(F.array(F.lower(n)), X.tokens(split(n), 2))


def with_base_tags(rows: DataFrame, name: str, symbol: str, signature: str, path: str, hint: str) -> DataFrame:
    """rows (with `lang`) and their base tags. The expressions of a language are applied to its rows only:
    all languages in one expression would be too large to compile. rows are read once for each language."""
    langs = [r.lang for r in rows.select("lang").distinct().collect()]  # no more than there are languages
    parts = []
    for lang in langs:
        mine = rows.filter(F.col("lang").eqNullSafe(F.lit(lang)))
        parts.append(mine.withColumn(name, base_tags(lang if lang in STYLES else "cpp", F.col(symbol), F.col(signature), F.col(path), F.col(hint))))
    return reduce(DataFrame.unionByName, parts) if parts else rows.withColumn(name, X.strings())


def path_tags(symbol: Column, path: Column) -> Column:
    """Tags from path and id alone, for callers without a language."""
    parts = F.concat(F.split(F.regexp_replace(path, r"(?<=.)\.[^./\\]*$", ""), r"[/\\]+"), F.split(symbol, "::"))
    return F.array_distinct(X.tokens(F.flatten(F.transform(parts, X.split_camel)), 2, BASE_STOP_WORDS["cpp"]))
