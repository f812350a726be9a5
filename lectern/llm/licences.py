"""License scans, by DataFrame functions alone.

A text's units are its lines, its sentences (over line ends), its first lines together, and the whole text. A unit that holds a telling term is
scored: its terms are counted in its own row, those that templates or bodies have are joined to these (constant lists, so the broadcast is bounded), and give, weighted
by TF-IDF, a sparse cosine with each. From LEAST and two shared terms on it is a statement of the best one's licence; the best statement's is the file's, and reserved rights
yield to any licence. Telling terms are taken from the templates, so that no unit without one reaches LEAST but by COMMON terms alone. A file by one of the usual names, or with a statement in its first lines, speaks for its directory. A file without statement of its own inherits from
the nearest directory above it that has one: directories, once each, are joined to their ancestors by path, and files to their directories.

IDF is over the templates, the statements that are looked for: in a corpus most of their terms are rare alike, and a file's score would change with what else is scanned. A term that none has weighs most, and lengthens a unit's vector.

Rows are told apart by two hashes of all they hold, not by their key: rows that share a key, or have none, have statements of their own, equal rows equal ones.
Directories with many below them (roots above all) are joined to these in SALTS parts.

Edge cases: null or empty text has no statement and may inherit; ties go to the licence first in order, of files to the first path; repeated
rows get a row each; rows without path (in documents: without source or doc_id) get their own statement only; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Licence names and the statements that stand for them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions of this license are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 license"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Copyright, all rights reserved"),
]
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
_AS_IS = "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"
_GNU = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
#: Licence texts, their notices and titles. They have no part in the IDF.
BODIES = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", _BSD),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", _GNU.format("This program", "General", 2)),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", _GNU.format("This program", "General", 3)),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC}. {_AS_IS}"),
    ("LGPL-3.0", _GNU.format("This library", "Lesser General", 3)),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT),
    ("MIT", _MIT_NOTICE),
    ("MIT", f"{_MIT}: {_MIT_NOTICE}. {_AS_IS}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Terms of templates that other prose has as well, versions and numbers: no statement by themselves. `mit` is also a German word.
COMMON = set("a above all an and any are as at be but by can copies copy do either except file files following for form forms free from general if in is it its kind language law list may mit must name names no nor not of on or org other out particular person persons public see source code shall so software subject that the this to under use used v version whether whom with without work writing written www you your".split())
LEAST = 0.6
#: Parts in which a directory meets those below it.
SALTS = 16
#: Yields to any licence that a file states besides.
RESERVED = "Proprietary"
#: Between sentences: their marks before white space, a colon that ends a line, a line without letters or digits.
END = r"[.;!?]+(?=\s|$)|:[ \t]*(?=\r?\n|$)|\n[^A-Za-z0-9\n]*(?=\n)"
#: The header region: so many first lines.
HEADER = 20
NOTICE_NAME = r"(?i)^(LICEN[CS]E|COPYING|NOTICE|UNLICENSE)(\..*)?$"


def _terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def weights() -> tuple[list[tuple[str, int, str, float, float]], float]:
    """(term, template number, licence, idf, share of the unit vector), and the idf of other terms."""
    bags = [Counter(_terms(t)) for _, t in TEMPLATES]
    df = Counter(t for b in bags for t in b)
    n = len(bags)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    out = []
    for i, ((licence, _), bag) in enumerate(zip(TEMPLATES, bags, strict=True)):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in bag.items()))
        out += [(t, i, licence, round(idf[t], 9), round(k * idf[t] / norm, 9)) for t, k in sorted(bag.items())]
    return out, round(math.log(1 + n) + 1, 9)


def bodies() -> list[tuple[str, int, str, float]]:
    """(term, number behind the templates', licence, share of the unit vector) of BODIES, by the templates' IDF."""
    table, other = weights()
    idf = {t: x for t, _, _, x, _ in table}
    out = []
    for i, (licence, text) in enumerate(BODIES, len(TEMPLATES)):
        w = {t: k * idf.get(t, other) for t, k in Counter(_terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out += [(t, i, licence, round(x / norm, 9)) for t, x in sorted(w.items())]
    return out


def _branches(words: list[str]) -> str:
    """A pattern of sorted words that reads each first letter once."""
    if words == [""]:
        return ""
    firsts = sorted({w[0] for w in words if w})
    out = "|".join(f + _branches([w[1:] for w in words if w[:1] == f]) for f in firsts)
    return f"(?:{out})?" if "" in words else f"(?:{out})" if len(firsts) > 1 else out


def telling_terms() -> list[str]:
    """Terms, so that what a unit shares with a template without any of them is COMMON, or too little for LEAST."""
    shares: dict[int, list[tuple[str, float]]] = {}
    for term, i, *_, share in [*weights()[0], *bodies()]:
        shares.setdefault(i, []).append((term, share))
    found = set()
    for own in shares.values():
        rest = sum(x * x for _, x in own)
        for term, x in sorted(own, key=lambda p: -p[1]):
            if rest < (LEAST - 0.01) ** 2:
                break
            if term not in COMMON and not term.isdigit():
                found.add(term)
                rest -= x * x
    return sorted(found)


def telling() -> str:
    """A pattern of telling_terms()."""
    return rf"(?i)(?<![a-z0-9]){_branches(telling_terms())}(?![a-z0-9])"


def units(files: DataFrame, header: int) -> DataFrame:
    """uid (of a row, in this run), h1, h2, unit (a number), top (whether it lies in the first lines, as many as header) and body of files(h1, h2, text)."""
    lines = F.split("text", "\n", -1)
    head = F.array_join(F.slice(lines, 1, header), "\n")
    of = lambda top: lambda x: F.struct(F.lit(top).alias("top"), x.alias("body"))
    every = F.concat(
        F.transform(lines, lambda x, i: F.struct((i < header).alias("top"), x.alias("body"))), F.transform(F.split("text", END, -1), of(False)), F.transform(F.split(head, END, -1), of(True)), F.array(of(True)(head), of(False)(F.col("text")))
    )
    cue = telling()
    rows = files.filter(F.col("text").rlike(cue)).withColumn("uid", F.monotonically_increasing_id())
    return rows.select("uid", "h1", "h2", F.posexplode(every).alias("unit", "u")).select("uid", "h1", "h2", "unit", "u.top", "u.body").filter(F.col("body").rlike(cue))


def counted(body: Column) -> Column:
    """An array of (term, tf) for a text, in its own row: its terms in order, and how far each one's run goes."""
    terms = F.sort_array(F.regexp_extract_all(F.lower(body), F.lit("[a-z0-9]+"), 0))

    def runs(s: Column) -> Column:
        n = F.size(s)
        begins = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), n) - i).alias("tf"))))[0]

    return F.transform(F.array(terms), runs)[0]  # the array is bound, so that it is made once


def statements(files: DataFrame, header: int) -> DataFrame:
    """h1, h2, licence, score and on_top, a row for each file(h1, h2, text) that has a statement, one for equal rows."""
    table, other = weights()
    idf = {t: x for t, _, _, x, _ in table}
    rows = [(t, i, licence, idf[t], share) for t, i, licence, _, share in table] + [(t, i, licence, idf.get(t, other), share) for t, i, licence, share in bodies()]
    vectors = files.sparkSession.createDataFrame(rows, "term string, template int, licence string, idf double, share double")
    known = sorted({r[0] for r in rows})
    weight = F.create_map(*[F.lit(x) for kv in sorted(idf.items()) for x in kv])
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    per_unit = units(files, header).select("uid", "h1", "h2", "unit", "top", counted(F.col("body")).alias("es")).select("*", F.filter("es", lambda e: e["term"].isin(known)).alias("ks"))
    # a term that no template has weighs `other`: of those only the counts are looked at
    unknown = F.filter("es", lambda e: ~e["term"].isin(known))
    norm = F.sqrt(square(F.transform(unknown, lambda e: e["tf"] * F.lit(other))) + square(F.transform("ks", lambda e: e["tf"] * F.coalesce(F.try_element_at(weight, e["term"]), F.lit(other)))))
    terms = per_unit.select("uid", "h1", "h2", "unit", "top", norm.alias("norm"), F.explode("ks").alias("e")).select("uid", "h1", "h2", "unit", "top", "norm", "e.term", "e.tf")
    met = terms.join(F.broadcast(vectors), "term").groupBy("uid", "unit", "template", "licence")
    dots = met.agg(F.sum(F.col("tf") * F.col("idf") * F.col("share")).alias("dot"), F.count("*").alias("shared"), *[F.first(c).alias(c) for c in ("h1", "h2", "top", "norm")]).filter("shared > 1")
    scored = dots.select("h1", "h2", "top", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= LEAST)
    best = F.min(F.struct((F.col("licence") == RESERVED).alias("r"), (-F.col("score")).alias("s"), "licence"))
    return scored.groupBy("h1", "h2").agg(best.alias("b"), F.max("top").alias("on_top")).select("h1", "h2", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), "on_top")


def nearest(dirs: DataFrame, of_dir: DataFrame) -> DataFrame:
    """d, up and up_licence: for each of dirs(dir) the nearest of of_dir(up, up_licence) that is the directory itself or lies above it."""
    parts = F.split("dir", "/", -1)
    above = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("up"))
    salted = above.withColumn("salt", F.pmod(F.xxhash64("dir"), F.lit(SALTS)).cast("int"))
    spread = of_dir.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(spread, ["up", "salt"]).groupBy("dir").agg(F.max(F.struct("depth", "up", "up_licence")).alias("n"))
    return met.select(F.col("dir").alias("d"), F.col("n.up").alias("up"), F.col("n.up_licence").alias("up_licence"))


def scan(files: DataFrame, header: int = HEADER) -> DataFrame:
    """files(file: a key, path, text) to file, path, licence, how (header, inherited, none), score and from_dir; header: the first lines that speak for a directory."""
    row = [F.col(c) for c in ("file", "path", "text")]
    parent: Column = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    files = files.select(*row, F.xxhash64(*row).alias("h1"), F.xxhash64(F.lit(1), *row).alias("h2"))
    own = common.materialize(statements(files.select("h1", "h2", "text"), header), "statements")
    placed = files.select("file", "path", parent.alias("dir"), "h1", "h2").join(own, ["h1", "h2"], "left")
    placed = common.materialize(placed.drop("h1", "h2"), "placed")
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(NOTICE_NAME)
    speaks = placed.filter(F.col("licence").isNotNull() & F.col("dir").isNotNull() & (F.col("on_top") | named))
    of_dir = speaks.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("b")).select(F.col("dir").alias("up"), F.col("b.licence").alias("up_licence"))
    found = nearest(placed.select("dir").filter(F.col("dir").isNotNull()).distinct(), of_dir)
    out = placed.join(found, F.col("dir") == F.col("d"), "left")
    inherits = F.col("licence").isNull() & F.col("up_licence").isNotNull()
    how = F.when(F.col("licence").isNotNull(), "header").when(inherits, "inherited").otherwise("none")
    return out.select("file", "path", F.coalesce("licence", "up_licence").alias("licence"), how.alias("how"), "score", F.when(inherits, F.col("up")).alias("from_dir"))


def _over_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents, whose path is made of source and doc_id: a folder for each source, in it one for each thousand, in that one for each hundred; the first of each hundred is its LICENSE."""
    d = F.col("doc_id")
    name = F.when(d % 100 == 0, "LICENSE").otherwise(d.cast("string"))
    path = F.concat("source", F.lit("/"), F.floor(d / 1000).cast("string"), F.lit("/"), F.floor(d / 100).cast("string"), F.lit("/"), name)
    return scan(common.documents(spark, sf_dir).select(d.alias("file"), path.alias("path"), "text")).withColumnRenamed("file", "doc_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement anywhere in the header region speaks for its directory, a title or shebang may stand before it; in a file named LICENSE one anywhere does; files without one inherit."""
    return _over_documents(spark, sf_dir)


def op2_license_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of op2_license_scan with its directory: how many files that has, how many of them say their licence themselves, and how many inherit. Files without path have no directory."""
    dir_ = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    out = common.materialize(_over_documents(spark, sf_dir).withColumn("dir", dir_), "scan")
    by_dir = out.filter("dir is not null").groupBy(F.col("dir").alias("d")).agg(F.count("*").alias("files"), F.count_if(F.col("how") == "header").alias("own"), F.count_if(F.col("how") == "inherited").alias("inherited"))
    return out.join(by_dir, F.col("dir") == F.col("d"), "left").drop("d")


def _sql() -> str:
    """All units, templates and bodies. END has look-ahead, which this database hasn't: what follows a mark is put back, and a sign stands for the end."""
    table, other = weights()
    idf = {t: x for t, _, _, x, _ in table}
    rows = [(t, i, licence, x, share) for t, i, licence, x, share in table] + [(t, i, licence, idf.get(t, other), share) for t, i, licence, share in bodies()]
    values = ", ".join(f"('{t}', {i}, '{licence}', cast({x} as double), cast({share} as double))" for t, i, licence, x, share in rows)
    cues = ", ".join(f"'{t}'" for t in telling_terms())
    marks = [("[.;!?]+([\\x20\\x09-\\x0D]|$)", 1), (":[ \\t]*(\\r?\\n|$)", 1), ("\\n[^A-Za-z0-9\\n]*(\\n)", 1)]

    def sentences(c: str) -> str:
        for pattern, group in marks:
            c = f"regexp_replace({c}, '{pattern}', chr(1) || '\\{group}', 'g')"
        return f"string_split({c}, chr(1))"

    head = f"array_to_string(lines[1:{HEADER}], chr(10))"
    return f"""
with v(term, template, licence, idf, share) as (values {values}),
i as (select distinct term, idf from v),
d as materialized (select row_number() over () as rid, doc_id, source || '/' || (doc_id // 1000) || '/' || (doc_id // 100) as dir,
  source || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || case when doc_id % 100 = 0 then 'LICENSE' else cast(doc_id as varchar) end as path, string_split(text, chr(10)) as lines, text from documents),
l as (select rid, unnest(lines) as body, generate_subscripts(lines, 1) <= {HEADER} as top from d union all select rid, unnest({sentences('text')}), false from d
  union all select rid, unnest({sentences(head)}), true from d union all select rid, {head}, true from d union all select rid, text, false from d),
s as (select row_number() over () as u, rid, top, regexp_extract_all(lower(body), '[a-z0-9]+') as terms from l where list_has_any(regexp_extract_all(lower(body), '[a-z0-9]+'), [{cues}])),
t as (select u, unnest(terms) as term from s),
w as (select u, t.term, count(*) as tf, count(*) * coalesce(any_value(i.idf), {other}) as w from t left join i on t.term = i.term group by u, t.term),
n as (select u, sqrt(sum(w * w)) as norm from w group by u),
p as (select u, template, licence, sum(tf * v.idf * share) as dot from w join v using (term) group by u, template, licence having count(*) > 1),
c as (select rid, top, licence, round(dot / norm, 6) as score from p join n using (u) join s using (u) where round(dot / norm, 6) >= {LEAST}),
o as (select rid, arg_min(licence, (licence = '{RESERVED}', -score, licence)) as licence, arg_min(score, (licence = '{RESERVED}', -score, licence)) as score, bool_or(top) as on_top from c group by rid),
k as (select dir, arg_min(licence, (-score, path)) as licence from d join o using (rid) where on_top or regexp_matches(path, '/LICENSE$') group by dir),
a as (select distinct dir, unnest(range(1, len(string_split(dir, '/')) + 1)) as depth from d),
u as (select dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') as up from a),
b as (select u.dir, arg_max(k.dir, depth) as up, arg_max(k.licence, depth) as licence from u join k on u.up = k.dir group by u.dir),
r as (select d.doc_id, d.path, d.dir, coalesce(o.licence, b.licence) as licence, case when o.licence is not null then 'header' when b.licence is not null then 'inherited' else 'none' end as how,
  o.score, case when o.licence is null then b.up end as from_dir from d left join o using (rid) left join b on d.dir = b.dir)
"""


SQL = f"{_sql()} select doc_id, path, licence, how, score, from_dir from r"
TREE_SQL = f"""{_sql()}, m as (select dir, count(*) as files, count(*) filter (where how = 'header') as own, count(*) filter (where how = 'inherited') as inherited from r where dir is not null group by dir)
select doc_id, path, licence, how, score, from_dir, r.dir, files, own, inherited from r left join m on r.dir = m.dir"""
