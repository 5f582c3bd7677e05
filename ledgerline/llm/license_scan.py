"""Licences of files: sparse TF-IDF cosine to templates, then inheritance along the path.

Every line with a licence cue, and the whole text of licence files, is a passage. Passages and
templates are vectors of terms weighted by their frequency and by how few passages of the
corpus have them; the best template is a file's licence if its cosine reaches the threshold.
Products run over the terms of the templates alone, a fixed list.

Licence bodies (the texts in ``licences``), usual headers and titles are compared apart from that,
by the cosine of the sets of word pairs: whole licence files, cue lines, and the blocks of lines
without an empty one between them that hold a cue. An SPDX line that names a known licence counts
as 1, the first name of an expression. The better of the two scores counts, of equal ones the line's.

A file without a licence takes that of the licence file in the nearest directory above it.
Directories, not files, are joined with the directories above them, so a directory that many
files lie in is joined once. Of several licence files in a directory the best match counts,
then the first path.

Null and empty texts have no passage. A null path lies in the root directory. Rows that repeat a
path are files of their own. An empty table gives an empty result. Columns of the files beside
path and text may have any name; the result has those that are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, empty_if_null, stored

# Licence names and the statements that stand for them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
}

CUE = r"(?i)licen[cs]e|copyright|spdx|rights reserved|public domain|creative commons"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
TERM = r"[a-z0-9]+"
THRESHOLD = 0.6

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, {1}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."
_LATER = "either version {0} of the License, or (at your option) any later version"
_CC = "This work is licensed under a Creative Commons {0} 4.0 International License."
# Usual headers, titles and long names, besides the bodies.
NOTICES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", _CC.format("Attribution")),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial")),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike")),
    ("GPL-2.0", _GNU.format("General Public License", _LATER.format(2))),
    ("GPL-2.0", _GNU.format("General Public License", "version 2 of the License")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _GNU.format("General Public License", _LATER.format(3))),
    ("GPL-3.0", _GNU.format("General Public License", "version 3 of the License")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", _LATER.format(3))),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
SPDX = re.compile(r"(?i)spdx-license-identifier:[\s(]*([a-z0-9.+-]+)")
SPDX_NAMES = {n.lower(): n for n in TEMPLATES if n != "Proprietary"}
LICENCE_TEXTS = Path(__file__).parent / "licences"


def pairs(text: str) -> set[str]:
    words = re.findall(TERM, text.lower())
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def body_pairs() -> list[tuple[str, set[str]]]:
    bodies = [(f.name.removesuffix(".txt"), f.read_text()) for f in sorted(LICENCE_TEXTS.glob("*.txt"))]
    return [(n, pairs(t)) for n, t in [*bodies, *NOTICES]]


def best_body(text: str, whole: bool, bodies: list[tuple[str, set[str]]]) -> tuple[str | None, float]:
    """The licence whose body, header, title or SPDX line comes nearest to a part of the text."""
    cue, blocks, block = re.compile(CUE), [], []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            block.append(line)
            continue
        if any(map(cue.search, block)):
            blocks.append("\n".join(block))
            blocks += [x for x in block if cue.search(x)] if len(block) > 1 else []
        block = []
    for part in blocks:
        for name in SPDX.findall(part):
            known = SPDX_NAMES.get(re.sub(r"(-only|-or-later|\+)$", "", name.lower().rstrip(".")))
            if known:
                return known, 1.0
    best = (None, 0.0)
    for part in dict.fromkeys([*([text] if whole else []), *blocks]):
        mine = pairs(part)
        for name, theirs in bodies if mine else []:
            score = round(len(mine & theirs) / (len(mine) * len(theirs)) ** 0.5, 6)
            if score > best[1]:
                best = (name, score)
    return best


def body_matcher():
    """A column function: text and whether it is a licence file to the nearest body and its score."""
    bodies = body_pairs()

    @F.pandas_udf("name string, score double")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, special in batches:
            found = [(None, 0.0) if t is None else best_body(t, w, bodies) for t, w in zip(texts, special)]
            yield pd.DataFrame(found, columns=["name", "score"])

    return match


def passages(files: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, number, path, directory and passages of each file; one scan of the texts."""
    path = empty_if_null("path")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    text = empty_if_null("text")
    special = name.rlike(LICENCE_FILE)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE))
    return files.select(
        F.struct(*keep).alias("kept"),
        path.alias("path"),
        F.monotonically_increasing_id().alias("row_no"),
        F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"),
        special.alias("is_licence_file"),
        body_matcher()(F.when(special | (F.size(lines) > 0), text), special).alias("body"),
        F.concat(lines, F.when(special, F.array(text)).otherwise(F.array().cast("array<string>"))).alias("passages"),
    )


def template_terms() -> dict[str, dict[str, int]]:
    terms = {}
    for name, text in TEMPLATES.items():
        words = re.findall(TERM, text.lower())
        terms[name] = {w: words.count(w) for w in words}
    return terms


def own_licences(spark: SparkSession, found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row_no, own_licence, own_score: the best template of each file that reaches the threshold."""
    terms = F.explode(F.regexp_extract_all(F.lower("passage"), F.lit(TERM), F.lit(0)))
    counted = stored(
        spark,
        found.select("row_no", F.posexplode("passages").alias("unit", "passage"))
        .select("row_no", "unit", terms.alias("term"))
        .groupBy("row_no", "unit", "term")
        .agg(F.count("*").alias("tf")),
        "passage-terms",
    )
    spread = stored(spark, counted.groupBy("term").agg(F.count("*").alias("df")), "term-spread")
    units = found.filter(F.size("passages") > 0).agg(F.sum(F.size("passages"))).first()[0] or 0
    weight = F.log((1 + F.lit(units)) / (1 + F.col("df"))) + 1.0

    wanted = template_terms()
    vocabulary = sorted({t for terms_ in wanted.values() for t in terms_})
    known = {r["term"]: r["w"] for r in spread.filter(F.col("term").isin(vocabulary)).select("term", weight.alias("w")).collect()}
    rare = float(spark.range(1).select(F.log(F.lit(1.0 + units)) + 1.0).first()[0])
    names, rows = list(wanted), []
    vectors = {n: {t: tf * known.get(t, rare) for t, tf in wanted[n].items()} for n in names}
    norms = {n: sum(w * w for w in v.values()) ** 0.5 for n, v in vectors.items()}
    for term in vocabulary:
        rows.append((term, *[vectors[n].get(term, 0.0) / norms[n] for n in names]))
    wide = spark.createDataFrame(rows, "t string, " + ", ".join(f"t{i} double" for i in range(len(names))))

    products = (
        counted.join(spread, "term")
        .withColumn("w", F.col("tf") * weight)
        .join(F.broadcast(wide), F.col("term") == F.col("t"), "left")
        .groupBy("row_no", "unit")
        .agg(
            F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
            *[F.sum(F.col("w") * F.coalesce(f"t{i}", F.lit(0.0))).alias(f"d{i}") for i in range(len(names))],
        )
    )
    scores = [F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("score"), F.lit(-i).alias("turn"), F.lit(n).alias("name")) for i, n in enumerate(names)]
    return (
        products.withColumn("best", F.array_max(F.array(*scores)))
        .groupBy("row_no")
        .agg(F.max("best").alias("best"))
        .filter(F.col("best.score") >= threshold)
        .select("row_no", F.col("best.name").alias("own_licence"), F.col("best.score").alias("own_score"))
    )


def inherited(spark: SparkSession, judged: DataFrame) -> DataFrame:
    """dir, inherited_licence, inherited_from: the nearest directory at or above with a licence file."""
    given = (
        judged.filter("is_licence_file and own_licence is not null")
        .groupBy(F.col("dir").alias("above"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("down"), "path", "own_licence")).alias("best"))
        .select("above", F.col("best.own_licence").alias("given"))
    )
    # 'a/b/c' lies in 'a/b/c', 'a/b', 'a' and the root ''.
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    levels = judged.select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), depth)))
    above = F.array_join(F.slice(parts, 1, F.col("depth")), "/")
    return (
        levels.withColumn("above", above)
        .join(given, "above")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "above", "given")).alias("nearest"))
        .select("dir", F.col("nearest.given").alias("inherited_licence"), F.col("nearest.above").alias("inherited_from"))
    )


def scan_licences(
    spark: SparkSession, files: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """The kept columns (the path if none are named) with own, inherited and effective licence."""
    found = stored(spark, passages(files, keep or ["path"]), "passages")
    body = (F.col("body.score") >= threshold) & (F.col("body.score") > F.coalesce("own_score", F.lit(0.0)))
    judged = stored(
        spark,
        found.drop("passages")
        .join(own_licences(spark, found, threshold), "row_no", "left")
        .withColumn("own_licence", F.when(body, F.col("body.name")).otherwise(F.col("own_licence")))
        .withColumn("own_score", F.when(body, F.col("body.score")).otherwise(F.col("own_score"))),
        "own-licences",
    )
    joined = judged.join(inherited(spark, judged), "dir", "left")
    return joined.select(
        "kept.*",
        "own_licence",
        "own_score",
        "inherited_licence",
        "inherited_from",
        F.coalesce("own_licence", "inherited_licence").alias("licence"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/ten thousands/hundreds/number.txt.

    Every tenth one is the licence file of its directory, every hundredth of the one above.
    """
    thousands, hundreds = F.expr("doc_id div 10000"), F.expr("doc_id div 100")
    path = (
        F.when(F.col("doc_id") % 100 == 0, F.concat_ws("/", "source", thousands, F.lit("LICENSE")))
        .when(F.col("doc_id") % 10 == 0, F.concat_ws("/", "source", thousands, hundreds, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", thousands, hundreds, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    )
    return scan_licences(spark, documents(spark, sf_dir).select("doc_id", path.alias("path"), "text"), ["doc_id", "path"])


def _values() -> str:
    rows = [
        f"('{n}', {i}, '{t}', {tf})" for i, (n, terms) in enumerate(template_terms().items()) for t, tf in terms.items()
    ]
    return ", ".join(rows)


SQL = rf"""
WITH files AS (
  SELECT doc_id, coalesce(text, '') AS text,
         CASE WHEN doc_id % 100 = 0 THEN concat_ws('/', source, doc_id // 10000, 'LICENSE')
              WHEN doc_id % 10 = 0 THEN concat_ws('/', source, doc_id // 10000, doc_id // 100, 'LICENSE')
              ELSE concat_ws('/', source, doc_id // 10000, doc_id // 100, doc_id || '.txt') END AS path
  FROM documents),
placed AS (
  SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
         regexp_extract(path, '([^/]*)$', 1) = 'LICENSE' AS special, text FROM files),
passage AS (
  SELECT doc_id, 'line ' || i AS unit, lines[i] AS body
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM placed) a) b
  WHERE regexp_matches(lines[i], '{CUE}')
  UNION ALL SELECT doc_id, 'whole', text FROM placed WHERE special),
counted AS (
  SELECT doc_id, unit, term, count(*) AS tf
  FROM (SELECT doc_id, unit, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM passage) t
  GROUP BY ALL),
units AS (SELECT count(*) AS n FROM passage),
weight AS (
  SELECT term, ln((1 + n) / (1 + df)) + 1.0 AS idf
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term) s, units),
template(name, turn, term, tf) AS (VALUES {_values()}),
tw AS (
  SELECT name, turn, term, tf * coalesce(idf, ln(1.0 + n) + 1.0) AS w
  FROM template LEFT JOIN weight USING (term), units),
tn AS (SELECT name, sqrt(sum(w * w)) AS norm FROM tw GROUP BY name),
cw AS (SELECT doc_id, unit, term, tf * idf AS w FROM counted JOIN weight USING (term)),
cn AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM cw GROUP BY ALL),
scored AS (
  SELECT cw.doc_id, cw.unit, tw.name, tw.turn, round(sum(cw.w * (tw.w / tn.norm)) / any_value(cn.norm), 6) AS score
  FROM cw JOIN tw USING (term) JOIN tn ON tn.name = tw.name JOIN cn ON cn.doc_id = cw.doc_id AND cn.unit = cw.unit
  GROUP BY cw.doc_id, cw.unit, tw.name, tw.turn),
own AS (
  SELECT doc_id, name AS own_licence, score AS own_score FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, turn) AS nth FROM scored) r
  WHERE nth = 1 AND score >= {THRESHOLD}),
given AS (
  SELECT dir AS above, own_licence AS given FROM (
    SELECT dir, own_licence, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path, own_licence) AS nth
    FROM placed JOIN own USING (doc_id) WHERE special) g WHERE nth = 1),
nearest AS (
  SELECT dir, given AS inherited_licence, above AS inherited_from FROM (
    SELECT d.dir, g.given, g.above, row_number() OVER (PARTITION BY d.dir ORDER BY length(g.above) DESC) AS nth
    FROM (SELECT DISTINCT dir FROM placed) d JOIN given g
      ON g.above = '' OR d.dir = g.above OR starts_with(d.dir, g.above || '/')) x WHERE nth = 1)
SELECT doc_id, path, own_licence, own_score, inherited_licence, inherited_from,
       coalesce(own_licence, inherited_licence) AS licence
FROM placed LEFT JOIN own USING (doc_id) LEFT JOIN nearest USING (dir)
"""
