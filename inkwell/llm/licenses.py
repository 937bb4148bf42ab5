"""License scans with DataFrame operations only: sparse TF-IDF cosine, then inheritance along paths."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

# What licences say of themselves, by SPDX identifier: the statements of file headers, the
# titles and terms of licence files, and short forms. SPDX tags are added by rule below.
TEMPLATES = {
    "Apache-2.0": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license-2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license-2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed to the apache software foundation asf under one or more contributor license agreements see the notice file distributed with this work for additional information regarding copyright ownership the asf licenses this file to you under the apache license version 2.0",
        "apache license version 2.0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution",
    ),
    "MIT": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "use of this source code is governed by an mit style license that can be found in the license file",
    ),
    "ISC": (
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ),
    "BSD-2-Clause": (
        "released under the bsd 2 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is",
    ),
    "BSD-3-Clause": (
        "released under the bsd 3 clause license",
        "redistribution and use in source and binary forms are permitted under the bsd 3 clause license",
        "use of this source code is governed by a bsd style license that can be found in the license file",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is",
    ),
    "GPL-2.0": (
        "this work is licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "gnu general public license version 2 june 1991 copyright 1989 1991 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble",
    ),
    "GPL-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu general public license version 3 29 june 2007 copyright 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble",
    ),
    "LGPL-2.1": (
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
        "gnu lesser general public license version 2.1 february 1999 copyright 1991 1999 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    ),
    "LGPL-3.0": (
        "licensed under the gnu lesser general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu lesser general public license version 3 29 june 2007 copyright 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    ),
    "AGPL-3.0": (
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu affero general public license version 3 19 november 2007 copyright 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble",
    ),
    "MPL-2.0": (
        "subject to the terms of the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
        "mozilla public license version 2.0 1 definitions 1.1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    ),
    "Unlicense": (
        "released under the unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "CC0-1.0": (
        "dedicated to the public domain under cc0 1.0",
        "creative commons legal code cc0 1.0 universal",
    ),
    "CC-BY-4.0": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
}
#: What a line has that may begin a statement.
CUE = r"(?i)licen[sc]e|copyright|spdx|redistribution|public domain|permission is hereby granted|permission to use|free software"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
LEAST = 0.6
#: A licence is in doubt if another one is as similar but for so much.
DOUBT = 0.03
#: Words that are compared from the line of a cue on: headers and texts of licences have about so many. 0: the line alone.
WINDOWS = (0, 12, 24, 48, 80, 110, 160, 200)
#: Lines that a window may reach over.
LINES = 60
#: Words of a term vector: letters and digits, with inner dots.
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def template_texts() -> list[tuple[str, int, str]]:
    """(license, number, text) of each template, SPDX tags among them; licences of the GNU family have two tags more."""
    out = []
    for name, texts in TEMPLATES.items():
        tags = [name] + ([f"{name}-only", f"{name}-or-later"] if "GPL" in name else [])
        every = [*texts, *(f"spdx license identifier {re.sub('-(?=[0-9])', ' ', t.lower()).replace('-', ' ')}" for t in tags)]
        out += [(name, k, t) for k, t in enumerate(every)]
    return out


def template_rows() -> list[tuple[str, int, str, float, float]]:
    """(license, number, term, unit weight) of each template, and the idf of each term."""
    terms = {(name, k): Counter(re.findall(TERM, t)) for name, k, t in template_texts()}
    df = Counter(t for c in terms.values() for t in c)
    idf = {t: round(math.log((1 + len(terms)) / (1 + n)) + 1, 6) for t, n in df.items()}
    out = []
    for (name, k), c in terms.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        out += [(name, k, t, round(n * idf[t] / norm, 6), idf[t]) for t, n in c.items()]
    return out


#: Of a term that no template has.
IDF_OTHER = round(math.log(1 + len(template_texts())) + 1, 6)


def similarities(terms: DataFrame, unit: list[str], sizes: tuple[int, ...]) -> DataFrame:
    """(*unit, size, license, similarity) of LEAST or more, for terms (*unit, term, ns: how often the term is in each of the sizes).

    Norms and products of all sizes are summed side by side, first within a task, so what is
    shuffled are sums and not terms.
    """
    spark = terms.sparkSession
    # a fixed, small table: the templates' terms
    weights = spark.createDataFrame(template_rows(), "license string, template int, term string, weight double, idf double")
    idf = F.broadcast(weights.select("term", "idf").distinct())
    w = [F.get("ns", F.lit(k)) * F.coalesce("idf", F.lit(IDF_OTHER)) for k in range(len(sizes))]
    weighted = terms.join(idf, "term", "left").select(*unit, "term", *(x.alias(f"w{k}") for k, x in enumerate(w)))
    norm = weighted.groupBy(*unit).agg(*(F.sum(F.col(f"w{k}") * F.col(f"w{k}")).alias(f"s{k}") for k in range(len(sizes))))
    both = weighted.join(F.broadcast(weights.select("license", "template", "term", "weight")), "term")
    dots = both.groupBy(*unit, "license", "template").agg(*(F.sum(F.col(f"w{k}") * F.col("weight")).alias(f"d{k}") for k in range(len(sizes))))
    each = F.array(*(F.struct(F.lit(n).alias("size"), F.round(F.try_divide(F.col(f"d{k}"), F.sqrt(f"s{k}")), 4).alias("similarity")) for k, n in enumerate(sizes)))
    near = F.filter(each, lambda x: x["similarity"] >= LEAST)
    return dots.join(norm, unit).select(*unit, "license", F.explode(near).alias("x")).select(*unit, "x.size", "license", "x.similarity")


def statements(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, size, license, similarity): where a line with a cue, or the words from it on, are similar enough to a licence's templates.

    Each line with a cue is compared alone and as the start of windows of several sizes, which
    hold headers and whole licence texts whatever their comment signs and line breaks. Texts are
    read once, for the lines with cues and what follows them.
    """
    at, sizes = F.col("line"), WINDOWS[1:]
    terms_of = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({TERM})"))
    lines = (
        files.where(F.col("text").rlike(CUE))
        .select(key, F.split("text", "\n").alias("ls"))
        .select(key, "ls", F.explode(F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.get("ls", i).rlike(CUE))).alias("line"))
    )
    lines = written(lines.select(key, "line", terms_of(F.get("ls", at)).alias("own"), F.slice(terms_of(F.array_join(F.slice("ls", at + 1, LINES), " ")), 1, sizes[-1]).alias("after")))
    own = lines.select(key, "line", F.explode("own").alias("term")).groupBy(key, "line", "term").agg(F.array(F.count("*")).alias("ns"))
    # windows are beginnings of the same words: where a term stands among them tells how often each has it
    places = lambda t: F.filter(F.transform("after", lambda y, i: F.when(y == t, i)), lambda i: i.isNotNull())
    before = lambda n: lambda i: i < n
    counts = lambda p: F.array(*(F.size(F.filter(p, before(n))) for n in sizes))
    after = F.transform(F.array_distinct("after"), lambda t: F.struct(t.alias("term"), F.get(F.transform(F.array(places(t)), counts), F.lit(0)).alias("ns")))
    window = lines.select(key, "line", F.explode(after).alias("x")).select(key, "line", "x.term", "x.ns")
    return similarities(own, [key, "line"], WINDOWS[:1]).union(similarities(window, [key, "line"], sizes))


def stated(files: DataFrame, key: str) -> DataFrame:
    """(key, own): the licence that each file states: the most similar (ties: first line, least window, name), and whether it is in doubt."""
    best = F.min_by(F.struct("similarity", "line", "size"), F.struct(-F.col("similarity"), "line", "size")).alias("b")
    each = statements(files, key).groupBy(key, "license").agg(best)
    found = each.groupBy(key).agg(
        F.min_by(F.struct("license", "b.similarity", "b.line"), F.struct(-F.col("b.similarity"), "b.line", "b.size", "license")).alias("top"),
        F.collect_list("b.similarity").alias("every"),  # one for each licence
    )
    near = F.size(F.filter("every", lambda x: F.round(F.col("top.similarity") - x, 4) <= DOUBT)) > 1
    return found.select(key, F.struct("top.license", "top.similarity", "top.line", near.alias("in_doubt")).alias("own"))


def parent(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def scan_licenses(files: DataFrame, key: str = "path") -> DataFrame:
    """key, path, license, similarity, in_doubt, line, origin, inherited_from: one row per row of files (path, text, key).

    origin is `own` for a stated licence, `inherited` if the nearest directory upwards with a
    licence file has one, else `none`. in_doubt: another licence is almost as similar. A directory
    with several licence files takes the most similar (ties: least path). Null and empty texts
    state nothing; a null path has no directory; rows that repeat a key and path get the same
    result each; an empty table gives no rows; columns besides key, path and text are ignored,
    whatever their names.
    """
    files = files.select(F.struct("path", key).alias("id"), "path", F.col(key).alias("key"), "text")
    best = written(stated(files, "id"))
    rows = files.select("key", "path", F.coalesce(parent(F.col("path")), F.lit("")).alias("dir"), F.col("path").isNull().alias("lost"), F.xxhash64("path", "key").alias("h"))
    found = best.select(F.col("id.path").alias("fpath"), F.col(f"id.{key}").alias("fkey"), "own")
    # directories with a licence file, then each directory's nearest such ancestor
    licensed = (
        found.where(F.col("fpath").rlike(LICENSE_FILE)).groupBy(parent(F.col("fpath")).alias("up"))
        .agg(F.min_by(F.struct("own.license", "own.similarity", "own.in_doubt"), F.struct(-F.col("own.similarity"), "fpath")).alias("theirs"))
    )
    parts = F.split("dir", "/")
    ups = rows.select("dir").distinct().select(
        "dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up")
    )
    near = ups.distinct().join(licensed, "up").groupBy("dir").agg(F.max_by(F.struct("up", "theirs"), F.length("up")).alias("near"))
    return (
        rows.join(found, F.col("path").eqNullSafe(F.col("fpath")) & F.col("key").eqNullSafe(F.col("fkey")), "left")
        .join(near, "dir", "left")
        .select(
            F.col("key").alias(key), "path",
            F.coalesce("own.license", F.when(~F.col("lost"), F.col("near.theirs.license"))).alias("license"),
            F.coalesce("own.similarity", F.when(~F.col("lost"), F.col("near.theirs.similarity"))).alias("similarity"),
            F.coalesce("own.in_doubt", F.when(~F.col("lost"), F.col("near.theirs.in_doubt"))).alias("in_doubt"),
            F.col("own.line").cast("long").alias("line"),
            F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull() & ~F.col("lost"), "inherited").otherwise("none").alias("origin"),
            F.when(F.col("own").isNull() & ~F.col("lost"), F.col("near.up")).alias("inherited_from"),
        )
    )


#: Path of a document: by source, language and id; those whose last line may state a licence are the licence files.
DOC_PATH = """concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'und'), concat('d', cast(floor(doc_id / 64) as bigint)),
  concat(case when {cue} then 'LICENSE-' else 'doc-' end, doc_id))"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    cue = f"substring_index(text, '\\n', -1) rlike r'{CUE}'"
    return scan_licenses(docs.select("doc_id", F.expr(DOC_PATH.format(cue=cue)).alias("path"), "text"), "doc_id")


_VALUES = ", ".join(f"('{a}', {k}, '{b}', {c}::double, {d}::double)" for a, k, b, c, d in template_rows())
ORACLE = rf"""
with files as (select doc_id, text, {DOC_PATH.format(cue=f"regexp_matches(string_split(text, chr(10))[-1], '{CUE}')")} as path from documents),
wt(license, template, term, weight, idf) as (values {_VALUES}),
idf as (select distinct term, idf from wt),
l0 as (select doc_id, path, string_split(text, chr(10)) as ls from files where regexp_matches(text, '{CUE}')),
l1 as (select doc_id, path, ls, unnest(range(len(ls))) as line from l0),
l2 as (select doc_id, path, line, regexp_extract_all(lower(ls[line + 1]), '{TERM}') as own,
  regexp_extract_all(lower(array_to_string(ls[line + 1:line + {LINES}], ' ')), '{TERM}') as after from l1 where regexp_matches(ls[line + 1], '{CUE}')),
l3 as (select *, unnest({list(WINDOWS)}) as size from l2),
t as (select doc_id, path, line, size, unnest(case when size = 0 then own else after[1:size] end) as term from l3),
n as (select doc_id, path, line, size, term, count(*) as n from t group by all),
w as (select n.*, n.n * coalesce(idf.idf, {IDF_OTHER}) as w from n left join idf using (term)),
norm as (select doc_id, path, line, size, sqrt(sum(w * w)) as norm from w group by all),
dots as (select doc_id, path, line, size, license, template, sum(w * weight) as dot from w join wt using (term) group by all),
s as (select doc_id, path, line, size, license, round(dot / norm, 4) as similarity from dots join norm using (doc_id, path, line, size)),
e as (select * from s where similarity >= {LEAST}
  qualify row_number() over (partition by doc_id, path, license order by similarity desc, line, size) = 1),
own as (select *, round(max(similarity) over (partition by doc_id, path) - similarity, 4) <= {DOUBT} as near from e),
top as (select doc_id, path, license, similarity, line, (count(*) filter (where near) over (partition by doc_id, path)) > 1 as in_doubt from own
  qualify row_number() over (partition by doc_id, path order by similarity desc, line, size, license) = 1),
dirs as (select distinct regexp_replace(path, '/[^/]*$', '') as dir from files),
lic as (select regexp_replace(path, '/[^/]*$', '') as up, license, similarity, in_doubt from top where regexp_matches(path, '{LICENSE_FILE}')
  qualify row_number() over (partition by regexp_replace(path, '/[^/]*$', '') order by similarity desc, path) = 1),
near as (select dir, up, license, similarity, in_doubt from dirs join lic on dir = up or starts_with(dir, up || '/')
  qualify row_number() over (partition by dir order by length(up) desc) = 1)
select f.doc_id, f.path, coalesce(o.license, e.license) as license, coalesce(o.similarity, e.similarity) as similarity, coalesce(o.in_doubt, e.in_doubt) as in_doubt, o.line::bigint as line,
  case when o.license is not null then 'own' when e.license is not null then 'inherited' else 'none' end as origin,
  case when o.license is null then e.up end as inherited_from
from files f left join top o on f.doc_id = o.doc_id and f.path = o.path
left join near e on e.dir = regexp_replace(f.path, '/[^/]*$', '')
"""
