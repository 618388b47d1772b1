"""Licence scans over a positional rare-token index.

A template is a licence's notice, word by word, with a key phrase that must
stand whole, common words included.  The rare words of the key are posted with
their templates and places.  A file
ranks the licence words it has by inverse document frequency; each template
whose key words are all there is looked up under the highest-ranked of them, a
hit proposes the place where the template would start, and the postings of its
other words are intersected by relative position: a place counts if the key
phrase stands, and scores the share of all indexed words that do.  DataFrame
functions only.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import let
from pitchline.session import cut

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` in order; ``key`` is the phrase in it that must stand whole.

    Words in STOP are not looked up, and outside the key any word may stand in
    their place.
    """

    label: str
    words: str
    key: str
    base: bool = False

    def tokens(self) -> list[tuple[int, str, bool]]:
        """(offset from the first key word, word, mandatory) of each word that counts: all of the key, and the rare ones beside it."""
        w, k = self.words.split(), self.key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        return [(i - at, x, at <= i < at + len(k)) for i, x in enumerate(w) if at <= i < at + len(k) or x not in STOP]


# Words too common to index, and the templates (notices of public licences).
STOP = frozenset("a and any are as be by for in is it may not of on or that the this to with you your".split())
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("reserved", "all rights reserved", "all rights reserved", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache license version 2 0"),
    Template("artistic-2.0", "licensed under the artistic license 2 0 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "artistic license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    Template("boost-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost software license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "cc0 1 0 universal"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0", "eclipse public license 2 0"),
    Template("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation", "gnu free documentation license"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-2.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "free software foundation either version 2 of the license"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-3.0-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "free software foundation either version 3 of the license"),
    Template("agpl", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software", "permission to use copy modify and or distribute"),
    Template("lgpl", "licensed under the gnu lesser general public license version 2 1 or any later version", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind", "permission is hereby granted free of charge"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license v 2 0"),
    Template("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2 0"),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at http scripts sil org ofl", "sil open font license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software released into the public domain"),
    Template("wtfpl", "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "do what the fuck you want to public license"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "in no event will the authors be held liable for any damages"),
)


def licence_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, hits)``: the templates' words in each text with their positions, none where no rare word of a key is among them."""
    vocabulary = sorted({w for t in templates for _, w, _ in t.tokens()})
    rare = sorted({w for t in templates for w in t.key.split() if w not in STOP})
    plain = F.coalesce(F.col(text_col), F.lit(""))
    # two letters outside A-Z have a lower case within a-z, so texts with them take the slower way
    low = F.when(plain.rlike("[\u212A\u0130]"), F.translate(plain, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(plain))
    w = F.array_remove(F.split(low, NOT_WORD), "")
    found = lambda x: F.filter(F.transform(x, lambda v, i: F.when(v.isin(vocabulary), F.struct(v.alias("w"), i.alias("i")))), lambda s: s.isNotNull())
    hits = lambda x: F.when(F.exists(x, lambda v: v.isin(rare)), found(x)).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    both = let(w, lambda x: F.struct(F.size(x).cast("long").alias("n"), hits(x).alias("hits")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), both.alias("_b")).select("doc_id", F.col("_b.n").alias("n_words"), F.col("_b.hits").alias("hits"))


def idf(found: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each indexed word over all documents.

    As many rows as the templates have words, whatever the input.
    """
    n = found.count()
    rows = found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count().collect()
    return {r["w"]: math.log((n + 1) / (r["count"] + 1)) for r in rows}


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _places(hits: Column, templates: tuple[Template, ...], weight: dict[str, float]) -> Column:
    """array<struct<t, p, score>>: the verified places of all templates in a row."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(templates):
        for w in {w for _, w, must in t.tokens() if must and w not in STOP}:  # a word that stands twice in a key is posted where it stands first
            postings.setdefault(w, []).append((n, min(o for o, v, must in t.tokens() if must and v == w)))
    # written as JSON constants, which the optimizer folds into literals: thousands of columns would weigh the plan down
    index = _constant({w: [{"t": n, "o": o} for n, o in posts] for w, posts in sorted(postings.items())}, "map<string,array<struct<t:int,o:int>>>")
    every = [{"tokens": [{"o": o, "w": w, "must": must} for o, w, must in t.tokens()], "key": sorted({w for _, w, must in t.tokens() if must})} for t in templates]
    known = _constant(every, "array<struct<tokens:array<struct<o:int,w:string,must:boolean>>,key:array<string>>>")
    idf = _constant({w: min(weight.get(w, math.inf), 1e9) for w in sorted(postings)}, "map<string,double>")
    reach = max(max(o for o, _, _ in t.tokens()) - min(o for o, _, _ in t.tokens()) for t in templates) + 1

    def ranked(own: Column) -> Column:
        """The file's words that keys are looked up under, rarest first."""
        rated = F.transform(own, lambda w: F.struct((-F.try_element_at(idf, w)).alias("r"), w.alias("w")))
        return F.transform(F.array_sort(F.filter(rated, lambda x: x["r"].isNotNull())), lambda x: x["w"])

    def leads(words: Column, own: Column) -> Column:
        """The word each template is looked up under: the file's highest-ranked, null where a key word is missing."""
        first = lambda key: F.get(F.filter(words, lambda w: F.array_contains(key, w)), 0)
        return F.transform(known, lambda t: F.when(F.size(F.array_except(t["key"], own)) == 0, first(t["key"])))

    def at(hit: Column, j: Column, lead: Column) -> Column:
        # a position has one hit at most, so all hits in reach are that near in the array too
        near = F.slice(hits, F.greatest(j - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))

        def check(post: Column) -> Column:
            start = hit["i"] - post["o"]
            tokens = F.get(known, post["t"])["tokens"]
            stands = F.filter(tokens, lambda k: F.exists(near, lambda y: (y["i"] == start + k["o"]) & (y["w"] == k["w"])))
            must = F.size(F.filter(tokens, lambda k: k["must"]))
            return let(stands, lambda s: F.when(F.size(F.filter(s, lambda k: k["must"])) == must, F.struct(post["t"].alias("t"), start.alias("p"), (F.size(s) / F.size(tokens)).alias("score"))))

        posts = F.filter(F.coalesce(F.try_element_at(index, hit["w"]), F.array()), lambda post: F.get(lead, post["t"]) == hit["w"])
        return F.filter(F.transform(posts, check), lambda x: x.isNotNull())

    led = lambda own: let(ranked(own), lambda words: leads(words, own))
    found = let(let(F.array_distinct(F.transform(hits, lambda h: h["w"])), led), lambda lead: F.flatten(F.transform(hits, lambda h, j: at(h, j, lead))))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<t:int,p:int,score:double>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, places`` and their summary.

    ``places`` lists (label, base, word, score) of each verified place;
    ``n_base``, ``first_word`` and ``last_word`` count and bound the base
    places; ``labels`` are distinct and sorted; ``score`` is the largest share
    of a template's indexed words that stand at a place, 0 without one.
    A null text counts as empty.
    """
    found = cut(licence_words(docs, id_col, text_col, templates))
    labels = F.array(*(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base")) for t in templates))
    placed = found.select("doc_id", "n_words", _places(F.col("hits"), templates, idf(found)).alias("_p"), F.size("hits").alias("_n"))
    named = F.transform("_p", lambda x: F.struct(F.get(labels, x["t"])["label"].alias("label"), F.get(labels, x["t"])["base"].alias("base"), x["p"].alias("word"), x["score"].alias("score")))
    placed = placed.select("doc_id", "n_words", named.alias("places"), "_n")
    base = F.filter("places", lambda x: x["base"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    return placed.select(
        "doc_id",
        "n_words",
        "places",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["word"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["word"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for the digest columns, from the phrases: a key's words stand one after the other, and the score counts the notice's words around it."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({text(t.label)}, {t.base}, {text(t.words)}, {text(t.key)})" for t in templates)
    stop = ", ".join(map(text, sorted(STOP)))
    return rf"""
WITH tpl AS (SELECT label, base, string_split(words, ' ') AS t, string_split(key, ' ') AS k, len(string_split(split_part(' ' || words || ' ', ' ' || key || ' ', 1), ' ')) - 1 AS before
  FROM (VALUES {values}) v(label, base, words, key)),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
place AS (SELECT id, label, base, i, before, t FROM pos JOIN tpl ON x = k[1] JOIN d USING (id) WHERE w[i + 1 : i + len(k)] = k),
near AS (SELECT id, label, base, i, unnest(range(len(t))) AS j, before, unnest(t) AS x FROM place),
held AS (SELECT n.id, n.label, n.base, n.i, n.x = p.x AS stands FROM near n JOIN tpl USING (label) LEFT JOIN pos p ON p.id = n.id AND p.i = n.i - n.before + n.j
  WHERE n.x NOT IN ({stop}) OR (n.j >= n.before AND n.j < n.before + len(k))),
good AS (SELECT id, label, base, i AS p, count(*) FILTER (stands) / count(*) AS score FROM held GROUP BY ALL),
g AS (SELECT id, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM good GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (id)
"""
