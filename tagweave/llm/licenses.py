"""License scan with a positional index of rare tokens; DataFrame functions only.

Templates are whole licence texts or notices with mandatory key phrases; short
naming clauses ("released under the MIT license") are phrases of their own.

1. `scanned` lower-cases and tokenises every whole text once. Of texts that hold a
   word of the vocabulary it keeps the numbers of their words (0 for words of no
   phrase), and the places of vocabulary words: linear in the text.
2. `word_idf` counts in how many documents each vocabulary word occurs, over all
   documents, and ranks the words of each phrase and template by inverse document
   frequency.
3. `with_matches` looks the rarest words of a file up in the postings: postings that
   agree on where a phrase or template would begin (position in the file minus
   position in the template) meet in one group. Phrases must begin at one place;
   the begin of a template may shift by `SLACK` words, as reworded copies do.
4. A phrase counts when it stands word for word at the place its postings point to.
   A template counts when rare words of half its weight agree and all its key phrases
   stand near the places they have in it. `score` is 1 then; where two or more
   postings agree and no more, half their share of the rare weight; else 0.

Templates and phrases are fixed lists, so the index, the vocabulary and the idf
table have a fixed size: at most a few hundred rows, which the driver writes into
the plan as literals. Nothing is cut off: every posting of every rare word of every
file is followed.

Defined cases: a null text is empty (no words, no labels, score 0); a text of any
length is read whole; rows with equal texts get equal results, found once for each
distinct text; an empty table gives an empty result; only A-Z are lower-cased; ties
in idf go to the word that sorts first; input columns named like an added column
are replaced, and names that begin with two underscores are reserved.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table, text_key, without

#: A word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are sought literally: words and label.
BASE: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Naming clauses: the phrase that must stand, and its label.
NAMES: tuple[tuple[str, str], ...] = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl-2.0"),
    ("eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons zero", "cc0"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("provided as is without any express or implied warranty in no event will the authors be held liable", "zlib"),
    ("boost software license", "boost"),
    ("do what the fuck you want to public license", "wtfpl"),
)
#: Whole texts: label, text, key phrases that must stand in it.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("without restriction including without limitation the rights", "shall be included in all copies or substantial portions"),
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
        ("with or without fee is hereby granted", "appear in all copies"),
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED.""",
        ("must retain the above copyright notice", "must reproduce the above copyright notice"),
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("except in compliance with the license", "unless required by applicable law or agreed to in writing"),
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see https://www.gnu.org/licenses/.""",
        ("as published by the free software foundation", "in the hope that it will be useful"),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
        ("to alter it and redistribute it freely", "must not be misrepresented"),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
        the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law.""",
        ("dedicate any and all copyright interest in the software to the public domain", "an overt act of relinquishment in perpetuity"),
    ),
)
#: Words that are never looked up: they carry no evidence.
FUNCTION_WORDS = frozenset("a all an and any are as at be been but by can do for free from have if in into is it its no nor not of on or other our out person should so such that the their this to under use used want we what whether whom will with without would you your 0 2 3".split())
RARE_PER_PHRASE = 3
RARE_PER_TEXT = 12
SLACK = 64
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words_in(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _place(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


TEXTS = [(label, words_in(text)) for label, text, _ in TEMPLATES]
#: Phrases by number: base ones, naming clauses, key phrases of the templates (which have no label of their own).
PHRASES = [(p.split(), label) for p, label in BASE + NAMES] + [(k.split(), "") for _, _, keys in TEMPLATES for k in keys]
#: Key phrases: phrase number, template number, place in the template, number of key phrases of the template.
KEYS = [(n, t, _place(TEXTS[t][1], PHRASES[n][0]), len(TEMPLATES[t][2])) for n, t in enumerate((t for t, x in enumerate(TEMPLATES) for _ in x[2]), len(BASE) + len(NAMES))]
VOCABULARY = sorted(({w for p, _ in PHRASES for w in p} | {w for _, t in TEXTS for w in t}) - FUNCTION_WORDS)
#: Numbers of the words that phrases are made of.
NUMBERS = {w: i + 1 for i, w in enumerate(sorted({w for p, _ in PHRASES for w in p}))}


def lower_az(text: Column) -> Column:
    """A-Z lower-cased; for ASCII texts that is what the faster built-in function does."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def constant(value, kind: str) -> Column:
    """A literal of any type."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scanned(texts: DataFrame) -> DataFrame:
    """(key, n_words, numbers, hits) of rows (key, words): numbers of all words and (pos, word) of vocabulary words, if there are any."""
    known = constant(NUMBERS, "map<string,int>")
    some = F.arrays_overlap("words", constant(VOCABULARY, "array<string>"))
    numbers = F.transform("words", lambda w: F.coalesce(F.try_element_at(known, w), F.lit(0)))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda h: h.word.isin(*VOCABULARY))
    return texts.select("key", F.size("words").cast("long").alias("n_words"), F.when(some, numbers).alias("numbers"), F.when(some, hits).alias("hits"))


def word_idf(hits: DataFrame, n_docs: int) -> dict[str, float]:
    """Inverse document frequency of each word of the vocabulary, which is fixed; a word that no document has gets the highest."""
    df = hits.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word"), "copies").groupBy("word").agg(F.sum("copies").alias("df"))
    words = hits.sparkSession.createDataFrame([(w,) for w in VOCABULARY], "word string")
    idf = words.join(df, "word", "left").select("word", F.log(F.lit(n_docs + 1.0) / (F.coalesce("df", F.lit(0)) + 1)).alias("idf"))
    return {r.word: r.idf for r in idf.collect()}


def postings(idf: dict[str, float], sequences: list[list[str]], most: int) -> dict[str, list[dict]]:
    """By word: {no, at, weight, total} of the sequences' rarest words, `most` of each."""
    found: dict[str, list[dict]] = {}
    for no, words in enumerate(sequences):
        rare = set(sorted({w for w in words if w not in FUNCTION_WORDS}, key=lambda w: (-idf[w], w))[:most])
        places = [(at, w) for at, w in enumerate(words) if w in rare]
        total = sum(idf[w] + 1 for _, w in places)
        for at, w in places:
            found.setdefault(w, []).append({"no": no, "at": at, "weight": idf[w] + 1, "total": total})
    return found


_POSTINGS = "map<string,array<struct<no:int,at:int,weight:double,total:double>>>"


def with_matches(texts: DataFrame, idf: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(key, no, begin, found, total, agree, stands) of phrases, and (key, no, found, total, agree, holds) of templates."""
    nothing = F.array().cast("array<struct<no:int,at:int,weight:double,total:double>>")
    by_phrase = constant(postings(idf, [p for p, _ in PHRASES], RARE_PER_PHRASE), _POSTINGS)
    by_text = constant(postings(idf, [t for _, t in TEXTS], RARE_PER_TEXT), _POSTINGS)
    shapes = constant([[NUMBERS[w] for w in p] for p, _ in PHRASES], "array<array<int>>")

    def phrase_match(h: Column, p: Column) -> Column:
        begin, shape = h.pos - p.at, F.element_at(shapes, p.no + 1)
        stands = (begin >= 0) & (F.slice("numbers", F.greatest(begin, F.lit(0)) + 1, F.size(shape)) == shape)
        return F.struct(p.no.alias("no"), begin.alias("begin"), p.weight.alias("weight"), p.total.alias("total"), stands.alias("stands"))

    text_match = lambda h, p: F.struct(p.no.alias("no"), (h.pos - p.at).alias("begin"), p.at.alias("at"), p.weight.alias("weight"), p.total.alias("total"))
    met = lambda index, of: F.flatten(F.transform("hits", lambda h: F.transform(F.coalesce(F.try_element_at(index, h.word), nothing), lambda p: of(h, p))))
    phrases = texts.select("key", F.explode(met(by_phrase, phrase_match)).alias("m")).select("key", "m.*").groupBy("key", "no", "begin")
    phrases = stored(phrases.agg(F.sum("weight").alias("found"), F.first("total").alias("total"), F.count("*").alias("agree"), F.max("stands").alias("stands")).filter("stands or agree >= 2"))

    # a begin belongs to two overlapping stretches, so begins that lie within SLACK words meet in one
    stretch = F.explode(F.array(F.floor(F.col("begin") / SLACK), F.floor(F.col("begin") / SLACK) + 1)).alias("stretch")
    words = texts.select("key", F.explode(met(by_text, text_match)).alias("m")).select("key", "m.*").select("key", "no", stretch, "at", "weight", "total", F.lit(0).alias("keys"))
    of_key = F.element_at(constant({str(n): {"no": t, "at": at, "keys": k} for n, t, at, k in KEYS}, "map<string,struct<no:int,at:int,keys:int>>"), F.col("no").cast("string"))
    keys = phrases.filter(F.col("stands") & (F.col("no") >= KEYS[0][0])).withColumn("of", of_key).select("key", F.col("of.no").alias("no"), (F.col("begin") - F.col("of.at")).alias("begin"), (-F.col("no") - 1).alias("at"), "of.keys")
    keys = keys.select("key", "no", stretch, "at", F.lit(0.0).alias("weight"), F.lit(0.0).alias("total"), "keys")
    once = words.unionByName(keys).groupBy("key", "no", "stretch", "at").agg(F.first("weight").alias("weight"), F.first("total").alias("total"), F.first("keys").alias("keys"))
    stretches = once.groupBy("key", "no", "stretch").agg(F.sum("weight").alias("found"), F.max("total").alias("total"), F.count(F.when(F.col("at") >= 0, 1)).alias("agree"), F.count(F.when(F.col("at") < 0, 1)).alias("n_keys"), F.max("keys").alias("keys"))
    holds = (F.col("keys") > 0) & (F.col("n_keys") == F.col("keys")) & (F.col("total") > 0) & (2 * F.col("found") >= F.col("total"))
    return phrases, stretches.filter("agree >= 2").select("key", "no", "found", "total", holds.alias("holds"))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of df with n_words, n_base, first_word, last_word, base_labels, labels and score added."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = without(df, ADDED).withColumn("__key", text_key(body))
    words = F.array_remove(F.split(lower_az(body), BETWEEN), "")  # faster than extracting the words
    per_row = stored(scanned(df.select(text_key(body).alias("key"), words.alias("words"))))
    # rows of one key have equal values; hot keys are combined before the shuffle
    per_text = stored(per_row.groupBy("key").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("numbers").alias("numbers"), F.first("hits").alias("hits")))
    n_docs = per_text.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    with_hits = per_text.filter(F.size("hits") > 0)
    phrases, templates = with_matches(with_hits, word_idf(with_hits, n_docs))
    label = lambda labels: F.element_at(constant(labels, "array<string>"), F.col("no") + 1)
    is_base, found = F.col("stands") & (F.col("no") < len(BASE)), F.col("found") / F.col("total") / 2
    named = phrases.select("key", "begin", is_base.alias("is_base"), F.when(F.col("stands"), F.nullif(label([x for _, x in PHRASES]), F.lit(""))).alias("label"), F.when(F.col("stands") & (F.col("no") < KEYS[0][0]), 1.0).otherwise(F.when(F.col("no") < KEYS[0][0], found)).alias("score"))
    whole = templates.select("key", F.lit(None).cast("int").alias("begin"), F.lit(False).alias("is_base"), F.when(F.col("holds"), label([x for x, _ in TEXTS])).alias("label"), F.when(F.col("holds"), 1.0).otherwise(F.when(F.col("total") > 0, F.least(found, F.lit(0.5)))).alias("score"))
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    result = named.unionByName(whole).groupBy("key").agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("begin"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("begin"))).cast("long").alias("last_word"),
        joined(F.col("is_base")).alias("base_labels"),
        joined(F.lit(True)).alias("labels"),
        F.max("score").alias("score"),
    )
    result = per_text.select("key", "n_words").join(result, "key", "left").select(
        F.col("key").alias("__key"),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )
    # both sides are read anew, so that Spark can split a text that a third of the rows share
    return keyed.join(stored(result), "__key").drop("__key")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(sf_dir, "documents", spark).select("doc_id", "text")).select("doc_id", *ADDED)


def _sql() -> str:
    quote = lambda w: "'" + w + "'"
    values = lambda rows: ", ".join(f"({', '.join(map(str, r))})" for r in rows)
    phrases = values((i, quote(label), str(i < len(BASE)).lower(), quote(" ".join(p))) for i, (p, label) in enumerate(PHRASES))
    sequences = [(0, i, p) for i, (p, _) in enumerate(PHRASES)] + [(1, i, t) for i, (_, t) in enumerate(TEXTS)]
    places = values((kind, i, at, quote(w)) for kind, i, words in sequences for at, w in enumerate(words) if w not in FUNCTION_WORDS)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
phrases(pid, label, is_base, phrase) AS (VALUES {phrases}),
texts(tid, label) AS (VALUES {values((i, quote(x)) for i, (x, _) in enumerate(TEXTS))}),
keyed(pid, tid, plc, n_keys) AS (VALUES {values(KEYS)}),
places(kind, pid, plc, word) AS (VALUES {places}),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
vocab AS (SELECT DISTINCT word FROM places),
hits AS (SELECT rid, word, pos FROM w SEMI JOIN vocab USING (word)),
idf AS (SELECT word, ln(((SELECT count(*) FROM docs) + 1) / (coalesce(df, 0) + 1)) AS idf FROM vocab LEFT JOIN (SELECT word, count(DISTINCT rid) AS df FROM hits GROUP BY word) USING (word)),
rare AS (SELECT kind, pid, word FROM (SELECT kind, pid, word, row_number() OVER (PARTITION BY kind, pid ORDER BY idf DESC, word) AS r FROM (SELECT DISTINCT kind, pid, word FROM places) JOIN idf USING (word)) WHERE r <= CASE kind WHEN 0 THEN {RARE_PER_PHRASE} ELSE {RARE_PER_TEXT} END),
posts AS (SELECT kind, pid, plc, word, idf + 1 AS weight, sum(idf + 1) OVER (PARTITION BY kind, pid) AS total FROM places SEMI JOIN rare USING (kind, pid, word) JOIN idf USING (word)),
met AS (SELECT kind, rid, pid, plc, pos - plc AS beg, weight, total FROM hits JOIN posts USING (word)),
ver AS (SELECT m.*, label, is_base, beg >= 0 AND array_to_string(ws[greatest(beg, 0) + 1 : beg + len(string_split(phrase, ' '))], ' ') = phrase AS stands FROM (SELECT rid, pid, beg, sum(weight) AS found, any_value(total) AS total, count(*) AS agree FROM met WHERE kind = 0 GROUP BY ALL) m JOIN phrases USING (pid) JOIN docs USING (rid)),
named AS (SELECT rid, beg, is_base AND stands AS is_base, CASE WHEN stands THEN nullif(label, '') END AS label, CASE WHEN label = '' THEN NULL WHEN stands THEN 1.0::DOUBLE ELSE found / total / 2 END AS score FROM ver WHERE stands OR agree >= 2),
ev AS (SELECT rid, pid AS tid, plc AS e, weight, total, 0 AS n_keys, beg FROM met WHERE kind = 1 UNION ALL SELECT rid, tid, -pid - 1, 0, 0, n_keys, beg - plc FROM ver JOIN keyed USING (pid) WHERE stands),
st AS (SELECT DISTINCT rid, tid, e, weight, total, n_keys, unnest([floor(beg / {SLACK}.0), floor(beg / {SLACK}.0) + 1]) AS stretch FROM ev),
tpl AS (SELECT rid, tid, sum(weight) AS found, max(total) AS total, max(n_keys) > 0 AND count(*) FILTER (e < 0) = max(n_keys) AND max(total) > 0 AND 2 * sum(weight) >= max(total) AS holds FROM st GROUP BY rid, tid, stretch HAVING count(*) FILTER (e >= 0) >= 2),
ev2 AS (SELECT * FROM named UNION ALL SELECT rid, NULL, false, CASE WHEN holds THEN label END, CASE WHEN holds THEN 1.0 WHEN total > 0 THEN least(found / total / 2, 0.5) END FROM tpl JOIN texts USING (tid)),
res AS (SELECT rid, count(*) FILTER (is_base) AS n_base, min(beg) FILTER (is_base) AS first_word, max(beg) FILTER (is_base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (is_base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), ',') AS labels, max(score) AS score FROM ev2 GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score FROM docs LEFT JOIN res USING (rid)
"""


QUERIES = {"op9_license_scan": op9_license_scan}
SQL = {"op9_license_scan": _sql()}
