"""Operator 4: licence scan with a positional rare-token index (DataFrame operations only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeda.llm.shared import ascii_lower, picked, split_words

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text. Its mandatory key phrase are the `n_key` words from word `key` on."""

    label: str
    words: tuple[str, ...]
    key: int
    n_key: int

    @classmethod
    def of(cls, label: str, text: str, phrase: str | None = None) -> Template:
        words, key = tuple(text.split()), tuple((phrase or text).split())
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return cls(label, words, at, len(key))

    @property
    def phrase(self) -> tuple[str, ...]:
        return self.words[self.key : self.key + self.n_key]


# The phrases of the contract.
BASE = (
    Template.of("mit", "under the mit license"),
    Template.of("apache-2", "apache license version 2"),
    Template.of("cc-by-nc", "cc by nc"),
)
# Notices of public licences, as words; the second text is the phrase that must be there.
WARRANTY = "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
OTHERS = (
    Template.of(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights"
        " to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this"
        " permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
        " merchantability fitness for a particular purpose and noninfringement " + WARRANTY,
        "permission is hereby granted free of charge to any person",
    ),
    Template.of(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed"
        " under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "unless required by applicable law or agreed to in writing",
    ),
    Template.of("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    Template.of(
        "gpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
        " it is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "redistribute it and or modify it under the terms of the gnu general public license",
    ),
    Template.of("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    Template.of("agpl", "licensed under the gnu affero general public license version", "gnu affero general public license"),
    Template.of(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with"
        " the distribution",
        "redistribution and use in source and binary forms",
    ),
    Template.of(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mozilla public license",
    ),
    Template.of(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is"
        " provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "permission to use copy modify and or distribute this software",
    ),
    Template.of("cc0", "licensed under cc0 1 0 universal", "cc0 1 0"),
    Template.of("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template.of("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template.of(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"
        " commercial or non commercial and by any means",
        "released into the public domain",
    ),
    Template.of(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software"
        " for any purpose including commercial applications and to alter it and redistribute it freely",
        "permission is granted to anyone to use this software for any purpose",
    ),
    Template.of("bsl-1", "distributed under the boost software license version 1 0", "boost software license"),
)


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_frame(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = picked(docs, doc_id, text=text)
    return rows.select("doc_id", split_words(ascii_lower(F.col("text").cast("string")), GAPS).alias("words"))


def idf(worded: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """log(N / documents with the word) over all documents; one row per licence word reaches the driver."""
    found = F.explode(F.array_append(F.array_intersect("words", _literal(vocabulary)), F.lit("")))
    counts = {r["w"]: r["n"] for r in worded.select(found.alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


#: A place is one number: the template's times this, and the word at which its key phrase would start.
SPAN = 2**40


def index(templates: tuple[Template, ...], weights: dict[str, float], n_rare: int) -> tuple[dict[str, list[int]], list[int]]:
    """Postings of licence words, (template * SPAN - place in its key phrase), and how many words of each phrase have any.

    The index holds all words as rare as the n_rare-th rarest word of the phrase for which that is commonest: then a
    file's licence words of highest idf, those in the index, meet every phrase in n_rare places at least.
    """
    least = min(sorted((weights[w] for w in t.phrase), reverse=True)[: n_rare][-1] for t in templates)
    postings: dict[str, list[int]] = {}
    for k, t in enumerate(templates):
        for j, w in enumerate(t.phrase):
            if weights[w] >= least:
                postings.setdefault(w, []).append(k * SPAN - j)
    return postings, [sum(weights[w] >= least for w in t.phrase) for t in templates]


def placed(worded: DataFrame, templates: tuple[Template, ...], postings: dict[str, list[int]], needs: list[int]) -> DataFrame:
    """worded with `places`, where key phrases stand (template * SPAN + first word): look up, intersect by relative position, verify."""
    lookup = F.create_map(*[x for w, p in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.lit(v).cast("long") for v in p]))])
    found = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("w"), i.alias("i")))))
    # a word's place less its place in the phrase; a start before the text is below SPAN / 2 of no template
    starts = F.flatten(F.transform(found, lambda h: F.transform(F.element_at(lookup, h["w"]), lambda p: p + h["i"])))
    looked = worded.withColumn("starts", F.sort_array(starts))
    need = _literal(needs)
    # sorted, a start on which all indexed words of a phrase agree comes as often as there are such words
    first = lambda c, j: (j == 0) | (F.get("starts", j - 1) != c)
    agreed = lambda c, j: F.coalesce(F.get("starts", j + F.get(need, _of(c)) - 1) == c, F.lit(False))
    kept = F.filter("starts", lambda c, j: (c >= 0) & (_at(c) < SPAN // 2) & first(c, j) & agreed(c, j))
    phrases = F.array(*[_literal(t.phrase) for t in templates])
    same = F.filter(kept, lambda c: F.slice("words", _at(c).cast("int") + 1, F.size(F.get(phrases, _of(c)))) == F.get(phrases, _of(c)))
    return looked.withColumn("places", same).drop("starts")


def _of(place: Column) -> Column:
    return F.floor(place / F.lit(SPAN)).cast("int")


def _at(place: Column) -> Column:
    return F.pmod(place, F.lit(SPAN))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: tuple[Template, ...] = BASE, others: tuple[Template, ...] = OTHERS, n_rare: int = 2) -> DataFrame:
    """Find licence notices in whole texts; A-Z are lower-cased, words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.

    First pass: the inverse document frequency of every licence word over all documents. Second
    pass, without a shuffle: a document's licence words of highest idf are looked up in a positional
    index of the templates' key phrases; their places less those in the phrase give possible starts,
    those on which all indexed words of a phrase agree remain, and there the phrase is verified word by word.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest
    and largest start, else null), base_labels, labels (distinct, sorted, comma-joined; labels
    includes base_labels), score: over all verified places the largest share of the template's words
    that stand at their relative positions (1 for a base phrase, 0 without any place). Null or
    empty text: no words, labels ''. Each input row gives a row, with repeated or null doc_id too; an
    empty table gives an empty one.
    """
    templates = base + others
    worded = word_frame(docs, doc_id, text)
    postings, needs = index(templates, idf(worded, sorted({w for t in templates for w in t.phrase})), n_rare)
    found = placed(worded, templates, postings, needs).withColumn("n_words", F.size("words").cast("long"))
    whole, keys = F.array(*[_literal(t.words) for t in templates]), _literal([t.key for t in templates])

    def share(c: Column) -> Column:
        """Of a place the share of the template's words at their relative positions."""
        mine, start = F.get(whole, _of(c)), (_at(c) - F.get(keys, _of(c))).cast("int")
        same = F.filter(mine, lambda w, j: F.coalesce(F.when(start + j >= 0, F.get("words", F.greatest(start + j, F.lit(0))) == w), F.lit(False)))
        return F.size(same) / F.size(mine).cast("double")

    bases = F.transform(F.filter("places", lambda c: c < len(base) * SPAN), _at)
    label = lambda cs: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(cs, lambda c: F.get(_literal([t.label for t in templates]), _of(c))))))
    return found.select(
        "doc_id", "n_words", F.size(bases).cast("long").alias("n_base"), F.array_min(bases).cast("long").alias("first_word"), F.array_max(bases).cast("long").alias("last_word"),
        label(F.filter("places", lambda c: c < len(base) * SPAN)).alias("base_labels"), label(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", share)), F.lit(0.0)).cast("double").alias("score"),
    )


def oracle(base: tuple[Template, ...] = BASE, others: tuple[Template, ...] = OTHERS) -> str:
    """The same result by comparing every word of every document."""
    def quoted(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    rows = ", ".join(f"({k}, '{t.label}', {quoted(t.words)}, {quoted(t.phrase)}, {t.key}, {str(k < len(base)).lower()})" for k, t in enumerate(base + others))
    return rf"""
WITH t(k, label, words, phrase, key, base) AS (VALUES {rows}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
f AS (SELECT p.doc_id, p.w, p.i, t.* FROM p JOIN t ON p.w[p.i + 1] = t.phrase[1] AND p.w[p.i + 1 : p.i + len(t.phrase)] = t.phrase),
s AS (SELECT doc_id, i, label, base, len(list_filter(range(len(words)), lambda j: i + j - key >= 0 AND coalesce(w[i + j - key + 1] = words[j + 1], false))) / len(words)::DOUBLE AS share FROM f),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN g USING (doc_id)"""
