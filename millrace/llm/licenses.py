"""Operator 10: licence scans by sparse TF-IDF cosine and directory inheritance, in DataFrame operations only.

Identifier lines (SPDX-License-Identifier) are read as expressions and not compared: one identifier is that licence, known or not, with AND,
OR and WITH between several the expression is. Of the rest of a text that has a licence cue anywhere (or is a licence file), the units are its
lines with a cue, each of them with the line after it (titles wrap), and all its paragraphs; of those that are longer, windows of ``WINDOWS`` terms in
place of the whole. Units and the templates below, which are titles, short forms, header notices and paragraphs of the licences, become sparse
TF-IDF vectors over the templates' words and further dimensions, of half the highest weight, for other words; document frequencies are
counted over the words of all files. A unit has the licence of the template with the highest cosine, if that is at least ``COSINE`` and the
words that tell licences apart (``NAMES`` and version numbers) of the template are all in the unit. Files whose name is that of a licence file, or at least
half of whose words lie in cue lines, speak for their directory. A file without a licence of its own inherits from the nearest ancestor directory
that has one, found by joining its ancestor paths.

A cosine is at most the share of a unit's length that lies in the templates' words; only units where that share allows ``COSINE``, whatever they are
about, are exploded for the join. Templates are a fixed list. A directory may hold any part of the files: its rows are dealt over ``SALT`` keys in the join.

Defined results: one row for each row of files; null text has no units; a null path has no ancestors; repeated rows are
each given; identifiers go before cosines and the first identifier line before others; ties go to the template first in the list and, within a directory,
to the licence with most matched units, then by name; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

COSINE, WINDOWS, SALT = 0.55, (48, 16), 16

# How well-known licences are stated in short forms, header notices and paragraphs.
TEXTS = {
    "MIT": [
        "released under the mit license",
        "the mit license mit",
        "licensed under the mit license see license file in the project root for license information",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2.0",
        "apache license version 2.0 january 2004",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "licensed to the apache software foundation asf under one or more contributor license agreements the asf licenses this file to you under the apache license version 2.0",
        "terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "gnu general public license version 3 29 june 2007",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu general public license version 3",
    ],
    "GPL-2.0": [
        "this program is free software licensed under the gnu general public license version 2",
        "gnu general public license version 2 june 1991",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "gnu general public license version 2",
    ],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007"],
    "LGPL-2.1": [
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    ],
    "AGPL-3.0": [
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "MIT OR Apache-2.0": [
        "licensed under either of apache license version 2.0 or mit license at your option",
        "dual licensed under the mit license and the apache license version 2.0",
    ],
    "BSD-3-Clause": [
        "redistribution and use in source and binary forms with or without modification are permitted bsd license",
        "bsd 3-clause license",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "use of this source code is governed by a bsd-style license that can be found in the license file",
    ],
    "BSD-2-Clause": [
        "bsd 2-clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "BSD": ["licensed under the bsd license", "distributed under the terms of the bsd license"],
    "Zlib": [
        "zlib license",
        "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ],
    "BSL-1.0": ["boost software license version 1.0", "distributed under the boost software license version 1.0 see accompanying file license 1 0.txt or copy at http www.boost.org license 1 0.txt"],
    "ISC": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "MPL-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    ],
    "EPL-2.0": ["eclipse public license version 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means"],
    "CC-BY-4.0": ["this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0"],
    "CC-BY-NC-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC0-1.0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0 1.0 universal public domain dedication"],
    "Proprietary": ["all rights reserved", "copyright c all rights reserved"],
}
#: (licence, text) of every template, in order of precedence.
TEMPLATES = [(k, t) for k, texts in TEXTS.items() for t in texts]
#: Words that tell licences apart: a template that has one is only matched by units that have it too.
NAMES = "mit apache gnu lesser affero bsd bsd-style isc mozilla mpl eclipse creative commons cc cc0 by by-sa by-nc sharealike noncommercial unencumbered zlib boost redistributions redistribution either dual".split()
CUE = r"(?i)licen[cs]e|copyright|rights reserved|public domain|spdx|redistribut|permission is hereby|hereby granted|may be used to endorse|distribute this software|freely, subject to|must not be misrepresented"
#: An identifier line and its expression.
SPDX = r"(?i)spdx-license-identifier:[\x20\t]*([^\n]*)"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|unlicense)(?:[.-][^/]*)?$"


def _terms(text: Column) -> Column:
    clean = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[.-]+|[.-]+$", ""), r"^v([0-9])", "$1")
    return F.filter(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.-]+"), clean), lambda t: t != "")


def vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.split()})


def expression(text: Column) -> Column:
    """The licence that the first identifier line of a text names: an identifier or an expression, without -only and -or-later; null if there is none. Comment marks after it are no part of it."""
    said = F.filter(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda x: x.rlike("[A-Za-z0-9]"))
    # up to where words stop being joined by operators
    line = F.regexp_replace(F.get(said, F.lit(0)), r"^[\x20\t(]*([A-Za-z0-9.+:-]+(?:[\x20\t()]+(?i:AND|OR|WITH)[\x20\t()]+[A-Za-z0-9.+:-]+)*).*$", "$1")
    words = F.transform(F.regexp_extract_all(line, F.lit(r"([A-Za-z0-9][A-Za-z0-9.+:-]*)"), 1), lambda w: F.when(w.rlike("^(?i:AND|OR|WITH)$"), F.upper(w)).otherwise(F.regexp_replace(w, r"-only$|-or-later$|\+$", "")))
    return F.array_join(words, " ")


def units(text: Column, path: Column) -> Column:
    """Term lists of the units of a text."""
    lines = F.split(text, "\n")
    cue = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda u: u["x"].rlike(CUE))
    pairs = F.transform(F.filter(cue, lambda u: u["i"] + 1 < F.size(lines)), lambda u: F.concat_ws("\n", u["x"], F.get(lines, u["i"] + 1)))
    paragraphs = F.filter(F.split(text, r"\n[\x20\t\r]*\n"), lambda x: x.contains("\n") | ~x.rlike(CUE))
    found = F.filter(F.transform(F.concat(F.transform(cue, lambda u: u["x"]), pairs, paragraphs), _terms), lambda t: F.size(t) > 0)
    none = F.array().cast("array<array<string>>")
    cut = lambda t, size: F.when(F.size(t) > size, F.transform(F.sequence(F.lit(0), F.size(t) - size // 2, F.lit(size // 2)), lambda i: F.slice(t, i + 1, size)))
    windows = F.flatten(F.transform(found, lambda t: F.concat(F.coalesce(cut(t, WINDOWS[0]), F.array(t)), F.coalesce(cut(t, WINDOWS[1]), none))))
    return F.when(text.rlike(CUE) | F.coalesce(path.rlike(LICENCE_FILE), F.lit(False)), windows).otherwise(none)


def scan(files: DataFrame) -> DataFrame:
    """files: doc_id, path, text. Returns doc_id, path, own_license, similarity, n_statements (matched units), license, inherited_from."""
    spark = files.sparkSession
    words = F.array(*map(F.lit, vocabulary()))
    text, path = F.coalesce(F.col("text"), F.lit("")), F.col("path").cast("string")
    said = F.aggregate(F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE)), F.lit(0), lambda acc, x: acc + F.size(F.split(x, r"[\x20\x09-\x0D]+")))
    rest = F.regexp_replace(text, SPDX, "")
    rows = files.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        path.alias("path"),
        F.when(text.contains(":"), expression(text)).alias("named"),
        F.when(text.rlike(CUE) | path.rlike(LICENCE_FILE), rest).alias("rest"),
        F.array_intersect(_terms(text), words).alias("known"),
        (F.coalesce(path.rlike(LICENCE_FILE), F.lit(False)) | F.when(text.rlike(CUE), 2 * said >= F.size(F.split(text, r"[\x20\x09-\x0D]+"))).otherwise(False)).alias("speaks"),
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # the texts that have units, which are few, stay in a table of their own
    rows = written(rows.withColumn("named", F.when(F.col("named") != "", F.col("named"))), "files")

    n_files = rows.count()
    df = {r["term"]: r["count"] for r in rows.select(F.explode("known").alias("term")).groupBy("term").count().collect()}  # at most the templates' words
    idf = {w: float(math.log((1 + n_files) / (1 + df.get(w, 0))) + 1) for w in vocabulary()}
    weight = spark.createDataFrame(list(idf.items()), "term string, idf double")
    unknown = float(math.log(1 + n_files) + 1) / 2

    templates = spark.createDataFrame([(i, k, v.split()) for i, (k, v) in enumerate(TEMPLATES)], "t int, template string, terms array<string>")
    tvec = templates.select("t", "template", F.explode("terms").alias("term")).groupBy("t", "template", "term").agg(F.count("*").alias("tf")).join(weight, "term").withColumn("w", F.col("tf") * F.col("idf")).withColumn("number", (F.col("term").rlike("^[0-9]") | F.col("term").isin(NAMES)).cast("int"))
    tnorm = tvec.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tnorm"), F.sum("number").alias("numbers"))
    names = F.broadcast(tnorm.join(templates.select("t", "template"), "t"))  # a fixed list, as the vectors are
    tvec = F.broadcast(tvec.select("t", "term", "w", "number"))

    of = rows.where("rest IS NOT NULL").select("row", F.posexplode(units(F.col("rest"), F.col("path"))).alias("at", "terms"))
    terms = F.array_distinct("terms")
    length = lambda known: F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.pow(F.size(F.filter("terms", lambda x: x == t)) * (known(t)), F.lit(2)))
    own_idf = F.create_map(*(F.lit(x) for pair in idf.items() for x in pair))
    of = of.where(F.size(F.array_intersect("terms", words)) > 0).withColumn("inside", length(lambda t: F.coalesce(own_idf[t], F.lit(0.0)))).withColumn("length", length(lambda t: F.coalesce(own_idf[t], F.lit(unknown))))
    of = of.where(F.col("inside") >= COSINE * COSINE * F.col("length") * (1 - 1e-9))
    svec = of.select("row", "at", F.sqrt("length").alias("norm"), F.explode(F.transform(terms, lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("tf")))).alias("s")).select("row", "at", "norm", "s.term", "s.tf")
    svec = svec.join(F.broadcast(weight), "term").withColumn("w", F.col("tf") * F.col("idf"))
    dots = svec.alias("s").join(tvec.alias("v"), "term").groupBy("row", "at", "t").agg(F.sum(F.col("s.w") * F.col("v.w")).alias("dot"), F.sum("number").alias("found"), F.first("norm").alias("norm"))
    dots = dots.join(names, "t").where("found = numbers")
    cosine = dots.withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 9))
    best = cosine.groupBy("row", "at").agg(F.max(F.struct("cosine", (-F.col("t")).alias("t"), "template")).alias("b")).where(F.col("b.cosine") >= COSINE)
    own = best.groupBy("row").agg(F.max(F.struct("b.cosine", "b.t", "b.template")).alias("o"), F.count("*").alias("n_statements"))

    named, statements = F.col("named"), F.coalesce("n_statements", F.lit(0).cast("long")) + F.col("named").isNotNull().cast("long")
    found = rows.join(own, "row", "left").select("doc_id", "path", "row", F.coalesce(named, "o.template").alias("own_license"), F.when(named.isNotNull(), 1.0).otherwise(F.col("o.cosine")).alias("similarity"), statements.alias("n_statements"), "speaks")
    found = written(found, "own-licences")

    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    spoken = found.where("speaks AND own_license IS NOT NULL AND path IS NOT NULL").groupBy(directory.alias("dir"), "own_license").agg(F.sum("n_statements").alias("n"))
    of_dir = spoken.groupBy("dir").agg(F.max_by("own_license", F.struct("n", F.translate("own_license", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ZYXWVUTSRQPONMLKJIHGFEDCBA"))).alias("dir_license"))
    of_dir = written(of_dir.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT))))), "directories")
    # every ancestor directory of a path, the empty one included, with its depth
    parts = F.split(directory, "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    bare = found.where("own_license IS NULL AND path IS NOT NULL").select("row", F.explode(ancestors).alias("a")).select("row", "a.depth", "a.dir", F.expr(f"CAST(row % {SALT} AS INT)").alias("salt"))
    near = bare.join(of_dir, ["dir", "salt"]).groupBy("row").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("near"))
    return found.join(near, "row", "left").select("doc_id", "path", "own_license", "similarity", "n_statements", F.coalesce("own_license", "near.dir_license").alias("license"), F.col("near.dir").alias("inherited_from"))


def with_paths(docs: DataFrame) -> DataFrame:
    """The documents table as a tree of files: source / language / block of a thousand ids / id."""
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string")).alias("path"), "text")


def oracle() -> str:
    """The scan of ``with_paths(documents)`` as DuckDB SQL."""
    words = "[" + ", ".join(f"'{w}'" for w in vocabulary()) + "]"
    values = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(TEMPLATES))
    clean = "regexp_replace(regexp_replace(x, '^[.-]+|[.-]+$', '', 'g'), '^v([0-9])', '\\1')"
    terms = lambda c: f"list_filter(list_transform(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}.-]+'), lambda x: {clean}), lambda x: x <> '')"
    space = r"'[\x20\x09-\x0D]+'"
    names = ", ".join(f"'{n}'" for n in NAMES)
    line = f"regexp_extract(text, '{SPDX}', 1)"
    chain = r"[\x20\t(]*([A-Za-z0-9.+:-]+([\x20\t()]+(?i:AND|OR|WITH)[\x20\t()]+[A-Za-z0-9.+:-]+)*)"
    ids = f"list_transform(regexp_extract_all(regexp_extract({line}, '^{chain}', 1), '[A-Za-z0-9][A-Za-z0-9.+:-]*'), lambda w: CASE WHEN upper(w) IN ('AND', 'OR', 'WITH') THEN upper(w) ELSE regexp_replace(w, '-only$|-or-later$|[+]$', '') END)"
    return f"""WITH files AS (SELECT row_number() OVER () AS r, doc_id, source || '/' || lang || '/' || (doc_id // 1000) || '/' || doc_id AS path, coalesce(text, '') AS text FROM documents),
 vocab AS (SELECT unnest({words}) AS term), n AS (SELECT count(*) AS n FROM files),
 df AS (SELECT term, count(*) AS df FROM (SELECT r, unnest(list_intersect({terms('text')}, {words})) AS term FROM files) GROUP BY term),
 weight AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf FROM vocab LEFT JOIN df USING (term) CROSS JOIN n),
 templates AS (SELECT * FROM (VALUES {values}) AS v(t, template, text)),
 tvec AS (SELECT t, template, term, count(*) * any_value(idf) AS w, CASE WHEN regexp_matches(term, '^[0-9]') OR term IN ({names}) THEN 1 ELSE 0 END AS number FROM (SELECT t, template, unnest(string_split(text, ' ')) AS term FROM templates) JOIN weight USING (term) GROUP BY t, template, term),
 tnorm AS (SELECT t, sqrt(sum(w * w)) AS tnorm, sum(number) AS numbers FROM tvec GROUP BY t),
 named AS (SELECT r, array_to_string({ids}, ' ') AS named FROM files WHERE array_to_string({ids}, ' ') <> ''),
 said_lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM files),
 cued AS (SELECT r, regexp_replace(text, '{SPDX}', '', 'g') AS text, string_split(regexp_replace(text, '{SPDX}', '', 'g'), chr(10)) AS lines FROM files WHERE regexp_matches(text, '{CUE}') OR regexp_matches(path, '{LICENCE_FILE}')),
 cue_lines AS (SELECT r, lines, i, lines[i] AS line FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM cued) WHERE regexp_matches(lines[i], '{CUE}')),
 raw AS (SELECT r, line AS u FROM cue_lines UNION ALL SELECT r, line || chr(10) || lines[i + 1] FROM cue_lines WHERE i < len(lines)
  UNION ALL SELECT r, p FROM (SELECT r, unnest(regexp_split_to_array(text, '\n[\x20\t\r]*\n')) AS p FROM cued) WHERE contains(p, chr(10)) OR NOT regexp_matches(p, '{CUE}')),
 whole AS (SELECT row_number() OVER () AS k, r, {terms('u')} AS terms FROM raw),
 windows AS (SELECT k, r, 0 AS i, terms FROM whole WHERE len(terms) <= {WINDOWS[0]} {" ".join(f"UNION ALL SELECT k, r, i * 1000 + {size}, terms[i + 1:i + {size}] FROM (SELECT k, r, terms, unnest(range(0, len(terms) - {size // 2} + 1, {size // 2})) AS i FROM whole WHERE len(terms) > {size})" for size in WINDOWS)}),
 svec AS (SELECT k, i, any_value(r) AS r, term, count(*) * coalesce(any_value(idf), (SELECT (ln(1 + n) + 1) / 2 FROM n)) AS w FROM (SELECT k, i, r, unnest(terms) AS term FROM windows) LEFT JOIN weight USING (term) GROUP BY k, i, term),
 snorm AS (SELECT k, i, sqrt(sum(w * w)) AS norm FROM svec GROUP BY ALL),
 best AS (SELECT r, k, i, template, t, cosine FROM (SELECT any_value(s.r) AS r, s.k, s.i, v.template, v.t, round(sum(s.w * v.w) / (any_value(norm) * any_value(tnorm)), 9) AS cosine FROM svec s JOIN tvec v USING (term) JOIN snorm ON snorm.k = s.k AND snorm.i = s.i JOIN tnorm ON tnorm.t = v.t GROUP BY s.k, s.i, v.template, v.t HAVING sum(v.number) = any_value(numbers))
  QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY cosine DESC, t) = 1),
 own AS (SELECT r, count(*) OVER (PARTITION BY r) AS n_statements, cosine, template AS own_license FROM best WHERE cosine >= {COSINE} QUALIFY row_number() OVER (PARTITION BY r ORDER BY cosine DESC, t) = 1),
 said_words AS (SELECT r, sum(len(regexp_split_to_array(line, {space}))) AS n FROM said_lines WHERE regexp_matches(line, '{CUE}') GROUP BY r),
 found AS (SELECT f.r, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, coalesce(named, own_license) AS own_license, CASE WHEN named IS NOT NULL THEN 1.0 ELSE cosine END AS similarity, coalesce(n_statements, 0) + (named IS NOT NULL)::BIGINT AS n_statements,
  regexp_matches(path, '{LICENCE_FILE}') OR 2 * coalesce(w.n, 0) >= len(regexp_split_to_array(text, {space})) AS speaks FROM files f LEFT JOIN named USING (r) LEFT JOIN own o ON o.r = f.r LEFT JOIN said_words w ON w.r = f.r),
 dirs AS (SELECT dir, own_license AS dir_license FROM (SELECT dir, own_license, sum(n_statements) AS n FROM found WHERE speaks AND own_license IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, own_license) = 1),
 near AS (SELECT f.r, d.dir, d.dir_license FROM found f JOIN dirs d ON d.dir = f.dir OR d.dir = '' OR starts_with(f.dir, d.dir || '/') WHERE f.own_license IS NULL QUALIFY row_number() OVER (PARTITION BY f.r ORDER BY length(d.dir) DESC) = 1)
 SELECT doc_id, path, own_license, similarity, n_statements, coalesce(own_license, dir_license) AS license, near.dir AS inherited_from FROM found LEFT JOIN near ON near.r = found.r"""
