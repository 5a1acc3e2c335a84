"""Licences of documents: headers and licence files compared with templates, then inherited from the nearest directory above.

Headers are lines with a licence cue. Each distinct header is one sparse TF-IDF vector; its cosine to the templates comes from joining on
tokens. A whole text with a cue is a vector too, compared with the full texts of licences: one that reaches `FILE_COSINE` is a licence file,
and so is one that is mostly headers. A document takes the licence it is the file of, or its best header; one that has none takes the licence
of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: notices by SPDX identifier
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 2-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse products. BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# fixed values: full texts of licences by SPDX identifier
FULL_TEXTS = (
    ("MIT", """MIT License Copyright (c)
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""),
    ("BSD-2-Clause", """BSD 2-Clause License Copyright (c) All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""),
    ("BSD-3-Clause", """BSD 3-Clause License Copyright (c) All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""),
    ("ISC", """ISC License Copyright (c)
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication
to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.
"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of
the acting entity and all other entities that control, are controlled by, or are under common control with that entity. For the purposes of this
definition, "control" means (i) the power, direct or indirect, to cause the direction or management of such entity, whether by contract or otherwise, or
(ii) ownership of fifty percent (50%) or more of the outstanding shares, or (iii) beneficial ownership of such entity. "You" (or "Your") shall mean an
individual or Legal Entity exercising permissions granted by this License. "Source" form shall mean the preferred form for making modifications, including
but not limited to software source code, documentation source, and configuration files. "Object" form shall mean any form resulting from mechanical
transformation or translation of a Source form, including but not limited to compiled object code, generated documentation, and conversions to other media
types. "Work" shall mean the work of authorship, whether in Source or Object form, made available under the License, as indicated by a copyright notice
that is included in or attached to the work (an example is provided in the Appendix below). "Derivative Works" shall mean any work, whether in Source or
Object form, that is based on (or derived from) the Work and for which the editorial revisions, annotations, elaborations, or other modifications
represent, as a whole, an original work of authorship. For the purposes of this License, Derivative Works shall not include works that remain separable
from, or merely link (or bind by name) to the interfaces of, the Work and Derivative Works thereof. "Contribution" shall mean any work of authorship,
including the original version of the Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted
to Licensor for inclusion in the Work by the copyright owner or by an individual or Legal Entity authorized to submit on behalf of the copyright owner.
"submitted" means any form of electronic, verbal, or written communication sent to the Licensor or its representatives, including communication on
electronic mailing lists, source code control systems, and issue tracking systems that are managed by, or on behalf of, the Licensor for the purpose of
discussing and improving the Work, but excluding communication that is conspicuously marked or otherwise designated in writing as "Not a Contribution."
2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,
non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform,
sublicense, and distribute the Work and such Derivative Works in Source or Object form.
3. Grant of Patent License. a patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license
applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination with
the Work. If You institute patent litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work constitutes
direct or contributory patent infringement, then any patent licenses granted to You shall terminate as of the date such litigation is filed.
4. Redistribution. You may reproduce and distribute copies of the Work in any medium, with or without modifications, provided that You meet the following
conditions: You must give any other recipients a copy of this License; You must cause any modified files to carry prominent notices stating that You
changed the files; You must retain all copyright, patent, trademark, and attribution notices; If the Work includes a "NOTICE" text file as part of its
distribution, then any Derivative Works must include a readable copy of the attribution notices contained within such NOTICE file.
5. Submission of Contributions. Unless You explicitly state otherwise, any Contribution shall be under the terms of this License, without any additional
terms. 6. Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as
required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.
7. Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied, including TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE. You are solely
responsible for determining the appropriateness of using or redistributing the Work and assume any risks associated.
8. Limitation of Liability. In no event and under no legal theory, whether in tort (including negligence), shall any Contributor be liable to You for
damages, including any direct, indirect, special, incidental, or consequential damages of any character (including loss of goodwill, work stoppage,
computer failure or malfunction, or any and all other commercial damages or losses), even if advised of the possibility of such damages.
9. Accepting Warranty or Additional Liability. You may choose to offer, and charge a fee for, acceptance of support, warranty, indemnity, or other liability
obligations and/or rights consistent with this License. You agree to indemnify, defend, and hold each Contributor harmless."""),
)
CUES = "licen[sc]e|copyright|spdx|released under|released into|permission is|permission to|redistribution and use|source code form|endorse"
TOKEN = "[a-z0-9]+"
LEAST_COSINE = 0.7
#: A document is a licence file if at least this share of its words stands in headers that match a template.
FILE_SHARE = 0.5
#: It is one too if its whole text is this near to the full text of a licence.
FILE_COSINE = 0.8


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def _word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))


def scored_headers(headers: DataFrame) -> DataFrame:
    """(header, license, score) for every distinct header whose best cosine reaches `LEAST_COSINE`; ties go to the smaller name.

    `headers` has header and n, how often it occurs. A token weighs ln((1 + N) / (1 + df)) + 1, N and df counted over all occurrences of
    headers and the templates; a vector has each of its tokens once.
    """
    spark = headers.sparkSession
    templates = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    ours = headers.select("header", "n", F.explode(_tokens(F.col("header"))).alias("token"))
    theirs = templates.select("template", "license", F.explode(_tokens(F.col("text"))).alias("token"))
    known = ours.select("token", "n").unionByName(theirs.select("token", F.lit(1).cast("bigint").alias("n"))).groupBy("token").agg(F.sum("n").alias("df"))
    total = headers.select("n").unionByName(templates.select(F.lit(1).cast("bigint").alias("n"))).agg(F.sum("n").alias("n")).first()[0]
    weight = known.select("token", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("weight"))
    by_template = theirs.join(weight, "token").withColumn("length", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template"))))
    by_header = ours.join(weight, "token").select("header", "token", "weight")
    lengths = by_header.groupBy("header").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("own"))
    met = by_header.select("header", "token").join(F.broadcast(by_template), "token")  # the templates are a fixed list
    dots = met.groupBy("header", "template", "license", "length").agg(F.sum(F.col("weight") * F.col("weight")).alias("dot"))
    scores = dots.join(lengths, "header").withColumn("score", F.round(F.col("dot") / (F.col("length") * F.col("own")), 6)).filter(F.col("score") >= LEAST_COSINE)
    best = F.min(F.struct((-F.col("score")).alias("minus"), F.col("license"))).alias("best")
    return scores.groupBy("header").agg(best).select("header", "best.license", (-F.col("best.minus")).alias("score"))


def _full_vectors() -> tuple[dict[str, float], list[dict[str, float]]]:
    """What each token of the full texts weighs, ln((1 + N) / (1 + df)) + 1 with N and df counted over them, and their unit vectors."""
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in FULL_TEXTS]
    df = Counter(t for c in counts for t in c)
    weights = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    vectors = [{t: n * weights[t] for t, n in c.items()} for c in counts]
    return weights, [{t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()} for v in vectors]


def whole_files(texts: DataFrame) -> DataFrame:
    """(key, license, score) of the texts (key, text; equal texts have equal keys) whose TF-IDF vector over all tokens has a cosine of at
    least `FILE_COSINE` to the full text of a licence; ties to the smaller name.

    Tokens of no full text weigh most. The templates are a fixed list of some hundred tokens, broadcast with a column for each licence, so a
    text is counted once and its cosines are sums over its tokens. Repeated texts only lengthen their vector.
    """
    weights, vectors = _full_vectors()
    places = [f"t{i}" for i in range(len(vectors))]
    columns = "token string, weight double, " + ", ".join(f"{c} double" for c in places)
    templates = texts.sparkSession.createDataFrame([(t, w, *(v.get(t, 0.0) for v in vectors)) for t, w in sorted(weights.items())], columns)
    most = math.log(1 + len(FULL_TEXTS)) + 1
    terms = texts.select("key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("token")).groupBy("key", "token").agg(F.count(F.lit(1)).alias("n"))
    value = F.col("n") * F.coalesce("weight", F.lit(most))
    met = terms.join(F.broadcast(templates), "token", "left")
    sums = met.groupBy("key").agg(F.sqrt(F.sum(value * value)).alias("own"), *(F.sum(value * F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in places))
    minus = lambda c: (-F.round(F.col(c) / F.col("own"), 6)).alias("minus")
    best = F.array_min(F.array(*(F.struct(minus(c), F.lit(name).alias("license")) for c, (name, _) in zip(places, FULL_TEXTS))))
    return sums.select("key", best.alias("best")).filter(-F.col("best.minus") >= FILE_COSINE).select("key", "best.license", (-F.col("best.minus")).alias("score"))


def scan(docs: DataFrame, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, path, license, score, n_headers, is_license_file, inherited_from and effective_license for every row of `docs`.

    Rows are told apart by id and path, and repeated rows are reported as often as they occur, with what was found in one of them. Null
    and empty texts have no headers, and a text without any cue has no licence. What the whole text says goes before its headers. A null path has no directory and inherits nothing. Where a directory holds several licence files,
    the best score counts, then the smaller name.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), path.alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    bearing = rows.filter(F.regexp_like(F.lower("text"), F.lit(CUES)))
    lines = bearing.select("doc_id", "path", _word_count(F.col("text")).alias("n_words"), F.explode(F.split("text", "\n")).alias("header"))
    lines = lines.filter(F.regexp_like(F.lower("header"), F.lit(CUES)))
    scored = scored_headers(lines.groupBy("header").agg(F.count(F.lit(1)).alias("n")))
    found = lines.join(scored, "header")
    best = F.min(F.struct((-F.col("score")).alias("minus"), F.col("license"))).alias("best")
    own = found.groupBy("doc_id", "path").agg(best, F.count(F.lit(1)).alias("n_headers"), F.sum(_word_count(F.col("header"))).alias("in_headers"), F.max("n_words").alias("n_words"))
    is_file = F.col("in_headers") >= FILE_SHARE * F.col("n_words")
    own = own.select("doc_id", "path", "best.license", (-F.col("best.minus")).alias("score"), "n_headers", is_file.alias("is_license_file"), F.lit(False).alias("whole"))
    keyed = bearing.select("doc_id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text")
    wholes = keyed.drop("text").join(whole_files(keyed.select("key", "text")), "key").select(
        "doc_id", "path", "license", "score", F.lit(0).cast("bigint").alias("n_headers"), F.lit(True).alias("is_license_file"), F.lit(True).alias("whole")
    )
    first = F.min(F.struct((~F.col("whole")).alias("part"), (-F.col("score")).alias("minus"), F.col("license"))).alias("best")
    own = own.unionByName(wholes).groupBy("doc_id", "path").agg(first, F.max("n_headers").alias("n_headers"), F.max("is_license_file").alias("is_license_file"))
    own = own.select("doc_id", "path", "best.license", (-F.col("best.minus")).alias("score"), "n_headers", "is_license_file")

    directory = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    files = own.filter(F.col("is_license_file") & F.col("path").isNotNull()).groupBy(directory(F.col("path")).alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("minus"), F.col("license"))).alias("file")
    ).select("above", F.col("file.license").alias("inherited"))
    parts = F.split("directory", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    directories = rows.filter("path IS NOT NULL").select(directory(F.col("path")).alias("directory")).distinct()
    nearest = directories.select("directory", F.explode(F.array_distinct(ups)).alias("above")).join(files, "above").groupBy("directory").agg(
        F.max_by(F.struct("above", "inherited"), F.length("above")).alias("near")
    ).select("directory", F.col("near.above").alias("above"), F.col("near.inherited").alias("inherited"))
    ids = rows.select("doc_id", "path", directory(F.col("path")).alias("directory")).alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.path").eqNullSafe(F.col("b.path"))
    full = ids.join(own.alias("b"), same, "left").select("a.*", "license", "score", "n_headers", "is_license_file").join(nearest, "directory", "left")
    lent = F.col("license").isNull() & F.col("inherited").isNotNull()
    return full.select(
        "doc_id", "path", "license", "score", F.coalesce("n_headers", F.lit(0)).cast("bigint").alias("n_headers"), F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.when(lent, F.col("above")).alias("inherited_from"), F.coalesce("license", "inherited").alias("effective_license"),
    )


def oracle() -> str:
    """The same over `documents` with source/lang/doc_id as path, in DuckDB's SQL."""
    templates = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    full = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(FULL_TEXTS))
    directory = "regexp_replace({}, '/?[^/]*$', '')"
    weight = f"ln((1.0 + {len(FULL_TEXTS)}) / (1.0 + {{}})) + 1.0"
    return f"""
    WITH templates(template, license, text) AS (VALUES {templates}),
    full_texts(template, license, text) AS (VALUES {full}),
    d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, coalesce(text, '') AS text FROM documents),
    lines AS (
        SELECT * FROM (
            SELECT doc_id, path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words, unnest(string_split(text, chr(10))) AS header FROM d
        ) WHERE regexp_matches(lower(header), '{CUES}')
    ),
    headers AS (SELECT header, count(*) AS n FROM lines GROUP BY header),
    ours AS (SELECT header, n, unnest(list_distinct(regexp_extract_all(lower(header), '{TOKEN}'))) AS token FROM headers),
    theirs AS (SELECT template, license, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS token FROM templates),
    known AS (SELECT token, sum(n) AS df FROM (SELECT token, n FROM ours UNION ALL SELECT token, 1 FROM theirs) GROUP BY token),
    total AS (SELECT (SELECT coalesce(sum(n), 0) FROM headers) + (SELECT count(*) FROM templates) AS n),
    weights AS (SELECT token, ln((1.0 + (SELECT n FROM total)::DOUBLE) / (1.0 + df::DOUBLE)) + 1.0 AS weight FROM known),
    by_template AS (SELECT template, license, token, weight, sqrt(sum(weight * weight) OVER (PARTITION BY template)) AS length FROM theirs JOIN weights USING (token)),
    by_header AS (SELECT header, token, weight FROM ours JOIN weights USING (token)),
    lengths AS (SELECT header, sqrt(sum(weight * weight)) AS own FROM by_header GROUP BY header),
    dots AS (
        SELECT h.header, t.template, t.license, t.length, sum(t.weight * t.weight) AS dot FROM by_header h JOIN by_template t USING (token)
        GROUP BY h.header, t.template, t.license, t.length
    ),
    scores AS (SELECT header, license, round(dot / (length * own), 6) AS score FROM dots JOIN lengths USING (header)),
    scored AS (
        SELECT header, license, score FROM scores WHERE score >= {LEAST_COSINE}
        QUALIFY row_number() OVER (PARTITION BY header ORDER BY score DESC, license) = 1
    ),
    found AS (SELECT lines.*, license, score FROM lines JOIN scored USING (header)),
    full_terms AS (
        SELECT template, license, token, count(*) AS n FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM full_texts) GROUP BY ALL
    ),
    full_weights AS (SELECT token, {weight.format("count(*)")} AS weight FROM full_terms GROUP BY token),
    full_vectors AS (SELECT template, license, token, n * weight AS x, sqrt(sum(n * weight * n * weight) OVER (PARTITION BY template)) AS length FROM full_terms JOIN full_weights USING (token)),
    texts AS (SELECT DISTINCT text FROM d WHERE regexp_matches(lower(text), '{CUES}')),
    text_terms AS (
        SELECT text, token, n * coalesce(weight, {weight.format("0.0")}) AS x
        FROM (SELECT text, token, count(*) AS n FROM (SELECT text, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM texts) GROUP BY ALL) LEFT JOIN full_weights USING (token)
    ),
    text_lengths AS (SELECT text, sqrt(sum(x * x)) AS own FROM text_terms GROUP BY text),
    text_dots AS (
        SELECT t.text, v.template, v.license, v.length, sum(t.x * v.x) AS dot FROM text_terms t JOIN full_vectors v USING (token)
        GROUP BY t.text, v.template, v.license, v.length
    ),
    whole AS (
        SELECT text, license, round(dot / (length * own), 6) AS score FROM text_dots JOIN text_lengths USING (text) WHERE round(dot / (length * own), 6) >= {FILE_COSINE}
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY round(dot / (length * own), 6) DESC, license) = 1
    ),
    by_header_lines AS (
        SELECT doc_id, path, arg_min(license, (-score, license)) AS license, max(score) AS score, count(*) AS n_headers,
               sum(len(regexp_extract_all(header, '[^\\x20\\x09-\\x0D]+'))) >= {FILE_SHARE} * max(n_words) AS is_license_file
        FROM found GROUP BY doc_id, path
    ),
    own AS (
        SELECT doc_id, path, arg_min(license, (part, -score, license)) AS license, arg_min(score, (part, -score, license)) AS score,
               max(n_headers) AS n_headers, bool_or(is_license_file) AS is_license_file
        FROM (
            SELECT doc_id, path, license, score, n_headers, is_license_file, 1 AS part FROM by_header_lines
            UNION ALL SELECT doc_id, path, license, score, 0, true, 0 FROM d JOIN whole USING (text)
        ) GROUP BY doc_id, path
    ),
    files AS (SELECT {directory.format("path")} AS above, arg_min(license, (-score, license)) AS inherited FROM own WHERE is_license_file GROUP BY 1),
    directories AS (SELECT DISTINCT {directory.format("path")} AS directory FROM d),
    nearest AS (
        SELECT directory, arg_max(above, length(above)) AS above, arg_max(inherited, length(above)) AS inherited
        FROM directories JOIN files ON above = '' OR directory = above OR starts_with(directory, above || '/') GROUP BY directory
    )
    SELECT d.doc_id, d.path, own.license, own.score, coalesce(n_headers, 0) AS n_headers, coalesce(is_license_file, false) AS is_license_file,
           CASE WHEN own.license IS NULL AND inherited IS NOT NULL THEN above END AS inherited_from, coalesce(own.license, inherited) AS effective_license
    FROM d LEFT JOIN own ON d.doc_id IS NOT DISTINCT FROM own.doc_id AND d.path = own.path LEFT JOIN nearest ON nearest.directory = {directory.format("d.path")}
    """
