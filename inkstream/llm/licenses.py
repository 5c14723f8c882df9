"""License scan by sparse TF-IDF cosine, with inheritance along directories.

Built-in functions only.  Lines that can be license notices (a cheap pattern over
the text) are compared with fixed templates: tokens get TF-IDF weights, and the
cosine is a sum over an equi-join with the templates' sparse vectors, which are fixed
values and so of a fixed size.  Paragraphs with such a line, and all from the first to
the last of them joined, are compared with whole headers and full license texts
(``license_texts``) in the same way.  A document's own license is its SPDX identifier's
or, without one, its best line's or block's.

A license file speaks for its directory: documents without a license of their own
inherit from the nearest ancestor directory that has one.  Each path is exploded into
its ancestors and equi-joined with the licensed directories; the deepest match wins by
a partial-aggregated maximum.  Only distinct directories take part; rows then meet their
directory's answer in a join whose small side is one row a directory.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and opening lines by SPDX identifier (public license texts, shortened).
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "MIT": ("Released under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "CC0 1.0 Universal Public Domain Dedication"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Confidential and proprietary."),
}
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
#: Headers of source files, by their telling paragraph and joined.
HEADERS = {
    name: (first.format(*fill), " ".join((first, rest)).format(*fill))
    for first, rest in [_GNU]
    for name, fill in {
        "GPL-1.0": ("", "1"), "GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.0": ("Library ", "2"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3"),
    }.items()
} | {"Apache-2.0": (_APACHE[0], " ".join(_APACHE)), "MPL-2.0": (_MPL,), "BSD-3-Clause": (_BSD,)}
#: Full license texts, by SPDX identifier.
TEXTS = Path(__file__).parent / "license_texts"
CUE = r"(?i)licen[sc]|copyright|spdx|all rights reserved|public domain|permission is hereby granted|redistribution and use|\bcc0\b"
#: Paragraphs of a license that name none of these disclaim warranties.
PART = CUE + r"|\bwarrant(?:y|ies)\b"
#: Between paragraphs: lines without letters and digits.
GAP = r"\n(?:[^A-Za-z0-9\n]*\n)+"
_ID = r"[(]*[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?[)]*"
SPDX = rf"(?i:SPDX-License-Identifier):[\x20\t]*(?!(?:NONE|NOASSERTION)\b)({_ID}(?:[\x20\t]+(?:OR|AND|WITH)[\x20\t]+{_ID})*)"
#: Whose line it is does not change what a reservation says.
HOLDER = r"(?i)(?:\bcopyright\b|\(c\)|\u00a9).*?(?=all rights reserved)"
#: Names of license files.
FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"
MIN_COSINE = 0.6
#: The same for blocks, whose longer texts share more common words.
MIN_BLOCK_COSINE = 0.8
#: A document of which license lines are at least this share of the words is a license file too.
FILE_SHARE = 0.5
_TOKEN = r"[^a-z0-9.]+"


def _tokens(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and (c.isalnum() or c == "."):
            word += c
        elif word:
            out.append(word)
            word = ""
    return [t for t in (w.strip(".") for w in out) if t]


@cache
def full_texts() -> dict[str, tuple[str, ...]]:
    """License texts with headers of source files."""
    texts = {p.stem: (p.read_text("utf-8"),) for p in sorted(TEXTS.glob("*.txt"))}
    return {name: texts.get(name, ()) + HEADERS.get(name, ()) for name in sorted(texts.keys() | HEADERS.keys())}


def template_vectors(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(license, template, token, unit weight), token weights and the weight of unknown tokens."""
    texts = [(name, i, _tokens(t)) for name, ts in templates.items() for i, t in enumerate(ts)]
    df = Counter(tok for _, _, toks in texts for tok in set(toks))
    idf = {tok: math.log((1 + len(texts)) / (1 + n)) + 1 for tok, n in df.items()}
    rows = []
    for name, i, toks in texts:
        tf = Counter(toks)
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        rows += [(name, i, t, n * idf[t] / norm) for t, n in tf.items()]
    return rows, idf, math.log(1 + len(texts)) + 1


def _split(words: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(words), _TOKEN), lambda t: F.btrim(t, F.lit("."))), lambda t: t != "")


def _score(lines: DataFrame, templates: dict[str, tuple[str, ...]], least: float) -> DataFrame:
    """(key, line, license, cosine, n_tokens): the best template of each (key, line, n_tokens, tokens), if it reaches ``least``.

    Lines whose known tokens carry too little of their length to get there are left out
    before they meet the templates.
    """
    spark = lines.sparkSession
    rows, idf, unknown = template_vectors(templates)
    vectors = F.broadcast(spark.createDataFrame(rows, "license string, template int, token string, unit double"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "token string, idf double"))
    counted = lines.select("key", "line", "n_tokens", F.explode("tokens").alias("token")).groupBy("key", "line", "n_tokens", "token").agg(F.count("*").alias("n"))
    weighed = counted.join(weights, "token", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    square = F.col("w") * F.col("w")
    norms = weighed.groupBy("key", "line", "n_tokens").agg(
        F.sqrt(F.sum(square)).alias("norm"),
        F.sqrt(F.sum(F.when(F.col("idf").isNotNull(), square).otherwise(F.lit(0.0)))).alias("most"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("token", "w"))).alias("known"),
    )
    known = norms.filter(F.col("most") >= (least - 1e-6) * F.col("norm")).select("key", "line", "n_tokens", "norm", F.explode("known").alias("x"))
    dots = known.select("key", "line", "n_tokens", "norm", "x.token", "x.w").join(vectors, "token").groupBy("key", "line", "n_tokens", "norm", "license", "template").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dots.withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= least)
    best = scored.groupBy("key", "line", "n_tokens").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("key", "line", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), "n_tokens")


def notices(files: DataFrame, least: float = 0.0) -> DataFrame:
    """(key, line, license, cosine, n_tokens): the best template of every candidate line of (key, text)."""
    lines = files.filter(F.col("text").rlike(CUE)).select("key", F.posexplode(F.split("text", "\n", -1)).alias("line", "words")).filter(F.col("words").rlike(CUE))
    bare = F.regexp_replace("words", HOLDER, "")
    return _score(lines.select("key", "line", F.size(_split(F.col("words"))).alias("n_tokens"), _split(bare).alias("tokens")), TEMPLATES, least)


def blocks(files: DataFrame, least: float = MIN_BLOCK_COSINE) -> DataFrame:
    """(key, line, license, cosine, n_tokens): the best full text or header of each paragraph with a cue or a disclaimer, numbered, and of all of them joined (-1)."""
    parts = files.filter(F.col("text").rlike(CUE)).select("key", F.split(F.regexp_replace("text", "\r\n?", "\n"), GAP, -1).alias("parts"))
    parts = parts.select("key", "parts", F.filter(F.transform("parts", lambda p, i: F.when(p.rlike(PART), i)), lambda i: i.isNotNull()).alias("at"))
    first, last = F.element_at("at", 1), F.element_at("at", -1)
    own = F.transform("at", lambda i: F.struct(i.alias("line"), F.get("parts", i).alias("words")))
    joined = F.array(F.struct(F.lit(-1).alias("line"), F.array_join(F.slice("parts", first + 1, last - first + 1), "\n").alias("words")))
    units = parts.filter(F.size("at") > 0).select("key", F.explode(F.when(F.size("at") > 1, F.concat(own, joined)).otherwise(own)).alias("u"))
    tokens = units.select("key", "u.line", _split(F.col("u.words")).alias("tokens"))
    return _score(tokens.select("key", "line", F.size("tokens").alias("n_tokens"), "tokens"), full_texts(), least)


def spdx(text: Column) -> Column:
    """The first SPDX expression, GNU identifiers without -only, -or-later and +; null without one."""
    found = F.regexp_extract(text, SPDX, 1)
    return F.when(found != "", F.regexp_replace(found, r"\b((?:A|L)?GPL-[0-9.]*[0-9])(?:-only|-or-later|\+)", "$1"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(key, license, cosine, inherited, directory) for each row of ``files`` (key, path, text).

    ``license`` is the document's own (its SPDX expression, with cosine 1, else its line or
    block of highest cosine, the first identifier at ties; a reservation of all rights only
    if there is nothing else) or, without one, that of the nearest ancestor directory with a license file:
    a file named as one, or one whose license lines are half its words.  Of several files
    in a directory the first path speaks.  Null where there is neither.

    Null and empty texts have no license of their own; a null path inherits nothing; rows
    with a null key are scanned like others; repeated rows each get a row, and different
    texts under one key are told apart; texts are read whole, however long; extra columns
    are ignored; an empty table gives an empty result.
    """
    # a row is its key and its text, so that texts under one key are not added up
    files = files.select(F.struct(F.col("key"), F.xxhash64("text").alias("text")).alias("key"), "path", "text")
    lines, units = notices(files.select("key", "text"), min_cosine), blocks(files.select("key", "text"))
    named = files.filter(F.col("text").rlike(CUE)).select("key", spdx(F.col("text")).alias("license")).filter("license is not null")
    own = lines.select("*", F.lit("line").alias("kind")).unionByName(units.select("*", F.when(F.col("line") < 0, "joined").otherwise("block").alias("kind")))
    own = own.unionByName(named.select("key", F.lit(0).alias("line"), "license", F.lit(1.0).alias("cosine"), F.lit(0).alias("n_tokens"), F.lit("spdx").alias("kind")))
    rank = F.when(F.col("kind") == "spdx", 0).when(F.col("kind") == "joined", 1).when(F.col("license") != "Proprietary", 2).otherwise(3)
    tokens = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_tokens"))), F.lit(0))
    best = own.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), (-F.col("cosine")).alias("c"), "license")).alias("b"), F.greatest(*map(tokens, ("line", "block", "joined"))).alias("n_tokens"))
    best = best.select("key", F.col("b.license").alias("own"), (-F.col("b.c")).alias("cosine"), "n_tokens")
    words = F.size(F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+"))
    rows = files.select("key", "path", words.alias("n_words")).join(best, "key", "left")
    speaks = F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(FILE) | (F.col("n_tokens") >= FILE_SHARE * F.col("n_words")))
    licensed = rows.filter(speaks).groupBy(_directory(F.col("path")).alias("directory")).agg(F.min(F.struct("path", "own")).alias("f")).select("directory", F.col("f.own").alias("theirs"))
    # ancestors of each directory that files without a license lie in
    lacking = rows.filter(F.col("own").isNull() & F.col("path").isNotNull()).select(_directory(F.col("path")).alias("at")).distinct()
    parts = F.split("at", "/")
    above = lacking.select("at", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(F.split("at", "/"), F.lit(1), n), "/"))).alias("directory"))
    nearest = above.join(licensed, "directory").groupBy("at").agg(F.max(F.struct(F.length("directory").alias("depth"), "directory", "theirs")).alias("n"))
    nearest = nearest.select("at", F.col("n.directory").alias("directory"), F.col("n.theirs").alias("theirs"))
    out = rows.withColumn("at", F.when(F.col("own").isNull(), _directory(F.col("path")))).join(nearest, "at", "left")
    return out.select(
        "key.key", F.coalesce("own", "theirs").alias("license"), "cosine", (F.col("own").isNull() & F.col("theirs").isNotNull()).alias("inherited"), "directory"
    )
