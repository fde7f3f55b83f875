"""Languages by id and extension, and the table functions that extract symbols.

`register` adds a language or replaces one (the last registration wins); an
unknown id falls back to C++.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import bodies, cpp
from .patterns import LANGUAGES

SYMBOL_COLUMNS = ("raw_id", "kind", "signature", "decl_line", "impl_line", "pos")
SYMBOL = "raw_id: string, kind: string, signature: string, decl_line: int, impl_line: int, pos: int"
#: Symbols are handed on in batches of so many bytes, about; a row without its snippet counts as so many.
BATCH_BYTES, ROW_BYTES = 2_000_000, 200
Extractor = Callable[[str, str], Iterator[tuple[str, str, str, int | None, int | None]]]


def _plain(lang: str) -> Extractor:
    return lambda code, path: ((*s, None) for s in LANGUAGES[lang].symbols(code, path))


EXTRACTORS: dict[str, Extractor] = {"cpp": cpp.declarations} | {n: _plain(n) for n in LANGUAGES}
_BUILT_IN = dict(EXTRACTORS)
EXTENSIONS: dict[str, str] = {e: "cpp" for e in cpp.EXTENSIONS} | {e: x.name for x in LANGUAGES.values() for e in x.extensions}


def register(lang: str, extensions: tuple[str, ...], extractor: Extractor) -> None:
    EXTRACTORS[lang] = extractor
    EXTENSIONS.update({e.lower(): lang for e in extensions})


def language_of(path: str) -> str | None:
    return EXTENSIONS.get(path.rpartition(".")[2].lower())


def extractor_of(lang: str | None) -> Extractor:
    return EXTRACTORS.get(lang or "", EXTRACTORS["cpp"])


def with_snippets(lang: str, code: str, path: str) -> Iterator[tuple]:
    """Rows of the language's extractor, each with its snippet: the body of this very declaration for the built-in languages,
    else what a search for the signature finds."""
    if lang in LANGUAGES and EXTRACTORS.get(lang) is _BUILT_IN[lang]:
        return ((*row, None, body()) for row, body in LANGUAGES[lang].with_bodies(code, path))
    if extractor_of(lang) is cpp.declarations:
        return ((*row, body()) for row, body in cpp.with_bodies(code, path))
    return ((*row, bodies.implementation(lang, code, row[2])) for row in extractor_of(lang)(code, path))


@udtf(returnType=SYMBOL)
class ExtractSymbols:
    """LATERAL extract_symbols(lang, path, code)."""

    def eval(self, lang: str, path: str, code: str):
        if code is None or path is None:
            return
        for pos, row in enumerate(extractor_of(lang)(code, path)):
            yield (*row, pos)


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("extract_symbols", ExtractSymbols)


def extract(files: DataFrame) -> DataFrame:
    """A row for each symbol of files (rel_path, lang, content, ...): the other columns, raw_id, kind, signature, lines, pos and snippet.

    Content isn't repeated on the rows; the snippet of a symbol is taken while its file is at hand. The guards of the
    C++ scanner, against long files and files with a NUL, hold for C++ only.
    """
    kept = [c for c in files.columns if c != "content"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            owners, rows, size = [], [], 0
            for i in range(batch.num_rows):
                lang, path, code = (of[c][i].as_py() for c in ("lang", "rel_path", "content"))
                for pos, s in enumerate(with_snippets(lang, code, path)):
                    owners.append(i)
                    rows.append((*s[:-1], pos, s[-1]))
                    size += ROW_BYTES + len(s[-1] or "")
                    if size >= BATCH_BYTES:  # by size, so that many small files share a batch and a large one has several
                        yield whole(of, owners, rows)
                        owners, rows, size = [], [], 0
            if rows:
                yield whole(of, owners, rows)

    def whole(of: dict[str, pa.Array], owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
        own = pa.array(owners, pa.int32())
        found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(of[c].take(own) for c in kept), *found], names=[*kept, *SYMBOL_COLUMNS, "snippet"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content"), *(c.replace(":", "") for c in SYMBOL.split(", ")), "snippet string"])
    return files.filter(F.length("content") > 0).mapInArrow(run, schema)
