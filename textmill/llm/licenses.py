"""Licence scan (operator 2), DataFrame functions only.

Units of a file are its runs of one to ``RUN`` lines, so that a header wrapped over lines is seen
whole, and its whole text. A unit and a template (notices, file headers, the texts of licences) are
sparse TF-IDF vectors over lower-case runs of letters and runs of digits, without ``STOP`` words: term
count times ``ln((1 + n) / (1 + df)) + 1`` over the ``n`` templates, half of that for numbers; a term
of no template weighs most. A file whose whole text has a cosine of ``THRESHOLD`` or more is a licence
file, and that is its own licence; another file's own licence is that of its best run that reaches it. A
directory has the licence of most of its licence files (ties: by name). A file without a licence of
its own takes that of its nearest ancestor directory that has one.

Only units with a cue word are scored, without loss: of each template so many terms are cues that
the others have less than ``THRESHOLD`` of its length, and a unit without any cue shares only those,
so its cosine is below the threshold. Of these, units are scored only if their words of some template
can outweigh the unknown ones: known words ``K`` and unknown ones ``U`` give a cosine of at most
``sqrt(K / (K + U))`` (in squared weights), which ``_can_reach`` bounds by their numbers alone.

Scale: a unit is scored under its own key, so no line, however frequent, makes a hot key;
templates are a fixed table and broadcast; inheritance joins distinct directories, and files meet
the table of directories in a join that Spark may split where a directory is large.

Edge cases: null and empty texts have no licence of their own but inherit; a null path is in
the root directory; files with the same id, path and text are rows with the same result; ties go to
the licence first by name; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.licence_texts import TEXTS
from textmill.llm.storage import materialize

THRESHOLD = 0.6
RUN = 4

# Licence names and their usual notices.
NOTICES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal Public Domain Dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Words that tell nothing, and identifiers of the public list of licences.
STOP = ["a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "if", "in", "is", "it", "its", "may", "no", "not", "of", "on", "or", "other", "our", "shall", "such", "that", "the", "their", "they", "this", "to", "we", "when", "which", "will", "with", "you", "your"]
IDENTIFIERS = ["AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
TEMPLATES = NOTICES + [(name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS] + TEXTS
TERMS = "[a-z]+|[0-9]+"


def cue_words() -> list[str]:
    """Of each template its heaviest words, until the rest is too short to reach the threshold."""
    counts = [Counter(t for t in re.findall(TERMS, text.lower()) if t not in STOP) for _, text in TEMPLATES]
    df = Counter(t for c in counts for t in c)
    out = set()
    for c in counts:
        weight = {t: (n * (math.log((1 + len(counts)) / (1 + df[t])) + 1) * (0.5 if t.isdigit() else 1)) ** 2 for t, n in c.items()}
        rest = sum(weight.values())
        most = rest * THRESHOLD**2 * (1 - 1e-9)
        # Words that other templates need anyway come first.
        for t in sorted((t for t in weight if not t.isdigit()), key=lambda t: (t not in out, -weight[t], t)):
            if rest < most:
                break
            rest -= weight[t]
            out.add(t)
        if rest >= most:
            raise ValueError("a template of too few words")
    return sorted(out)


KNOWN = sorted({t for _, text in TEMPLATES for t in re.findall(TERMS, text.lower()) if t not in STOP})
CUES = rf"(?i)(?<![a-z])(?:{'|'.join(cue_words())})(?![a-z])"


def _terms(text: Column) -> Column:
    """Only ASCII letters are made lower-case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.regexp_extract_all(lower, F.lit(TERMS), F.lit(0)), lambda t: ~t.isin(STOP))


def _weight(term: Column, idf: Column) -> Column:
    return F.when(term.rlike("^[0-9]"), idf / 2).otherwise(idf)


def _can_reach(terms: Column) -> Column:
    """Whether a unit of these terms can reach the threshold: ``K`` is at most the square of the known terms'
    number times the greatest weight of one, ``U`` at least the unknown words' number times their weight squared."""
    known = F.size(F.filter(terms, lambda t: t.isin(KNOWN)))
    unknown = F.size(F.filter(terms, lambda t: ~t.isin(KNOWN) & ~t.rlike("^[0-9]")))
    most, other = math.log((1 + len(TEMPLATES)) / 2) + 1, math.log(1 + len(TEMPLATES)) + 1
    return (known > 0) & (known * known * (most**2 * (1 - THRESHOLD**2) * (1 + 1e-9)) >= unknown * (THRESHOLD**2 * other**2))


def template_vectors(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(term, weight) of all template terms, and (template, license, term, share): ``share`` is the weight
    of a term in its template, brought to length one."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    terms = rows.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    idf = terms.groupBy("term").agg((F.log((1 + len(TEMPLATES)) / (1 + F.count("*"))) + 1).alias("idf")).select("term", _weight(F.col("term"), F.col("idf")).alias("weight"))
    weighed = terms.join(F.broadcast(idf), "term").select("template", "license", "term", (F.col("tf") * F.col("weight")).alias("w"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return idf, weighed.join(F.broadcast(norms), "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("share"))


def scores(files: DataFrame) -> DataFrame:
    """``files`` (file_id, text) -> the best (license, score) of each unit: file_id, lines (0: the whole text), line."""
    spark = files.sparkSession
    # A line is its terms, or null without a cue; a run joins those of its lines.
    each = F.transform(F.split("text", "\n"), lambda x: F.struct(_terms(x).alias("terms"), x.rlike(CUES).alias("cued")))
    cued = files.where(F.col("text").rlike(CUES)).select("file_id", each.alias("all"))

    def runs(n: int) -> Column:
        run = lambda i: F.slice("all", i + 1, n)
        starts = F.filter(F.sequence(F.lit(0), F.size("all") - n), lambda i: F.exists(run(i), lambda x: x["cued"]))
        found = F.transform(starts, lambda i: F.struct(F.lit(n).alias("lines"), i.alias("line"), F.flatten(F.transform(run(i), lambda x: x["terms"])).alias("terms")))
        return F.when(F.size("all") >= n, F.filter(found, lambda x: _can_reach(x["terms"]))).otherwise(F.array())

    whole = F.array(F.struct(F.lit(0).alias("lines"), F.lit(0).alias("line"), F.flatten(F.transform("all", lambda x: x["terms"])).alias("terms")))
    whole = F.filter(whole, lambda x: _can_reach(x["terms"]))
    units = cued.select("file_id", F.inline(F.concat(whole, *(runs(n) for n in range(1, RUN + 1)))))
    counted = units.select("file_id", "lines", "line", F.explode("terms").alias("term")).groupBy("file_id", "lines", "line", "term").agg(F.count("*").alias("tf"))
    idf, vectors = template_vectors(spark)
    other = _weight(F.col("term"), F.log(F.lit(1.0 + len(TEMPLATES))) + 1)
    weighed = counted.join(F.broadcast(idf), "term", "left").select("file_id", "lines", "line", "term", (F.col("tf") * F.coalesce("weight", other)).alias("w"))
    unit = ["file_id", "lines", "line"]
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy(*unit, "template", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    cosines = dots.join(norms, unit).select(*unit, "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = cosines.groupBy(*unit).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    return best.select(*unit, F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"))


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, nearest first; the root is the empty string."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.reverse(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (file_id, path, text) -> file_id, path, own_license, own_score, is_license_file, license,
    inherited_from (the directory; null where the licence is the file's own or none is found)."""
    directory = F.coalesce(F.regexp_extract(F.coalesce("path", F.lit("")), "^(.*)/[^/]*$", 1), F.lit(""))
    text = F.col("text").cast("string")
    rows = files.select(F.struct("file_id", "path", F.xxhash64(text).alias("hash")).alias("row"), directory.alias("dir"), text.alias("text"))
    found = materialize(scores(rows.select(F.col("row").alias("file_id"), "text").distinct()).where(F.col("score") >= threshold), "licence-units")
    own = found.groupBy("file_id").agg(
        F.min(F.when(F.col("lines") > 0, F.struct((-F.col("score")).alias("minus"), "license"))).alias("b"),
        F.min(F.when(F.col("lines") == 0, F.struct((-F.col("score")).alias("minus"), "license"))).alias("whole"),
    )
    best = F.coalesce("whole", "b")
    own = own.select(F.col("file_id").alias("row"), best["license"].alias("own_license"), (-best["minus"]).alias("own_score"), F.col("whole").isNotNull().alias("is_license_file"))
    marked = materialize(rows.drop("text").join(own, "row", "left").select("row.file_id", "row.path", "dir", "own_license", "own_score", "is_license_file"), "licence-files")
    votes = marked.where("is_license_file").groupBy("dir", "own_license").agg(F.count("*").alias("n"))
    licensed = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("minus"), "own_license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.own_license").alias("given"))
    dirs = marked.select("dir").distinct().select("dir", F.posexplode(_ancestors(F.col("dir"))).alias("up", "above"))
    nearest = dirs.join(licensed, "above").groupBy("dir").agg(F.min(F.struct("up", "above", "given")).alias("near")).select("dir", "near.above", "near.given")
    inherits = F.col("own_license").isNull()
    # As a table of its own, so that the join may be split where a directory is large.
    return marked.join(materialize(nearest, "licensed-directories"), "dir", "left").select(
        "file_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", "given").alias("license"),
        F.when(inherits, F.col("above")).alias("inherited_from"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """``docs`` as files: a directory for each source, in it one for each language, and below two levels by id."""
    level = lambda n, of: (F.coalesce(F.col("doc_id"), F.lit(0)) / n).cast("long") % of
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), level(1, 4).cast("string"), level(4, 3).cast("string"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    # Licence files stand one level up from where their id would put them.
    up = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), F.when(level(1, 5) == 0, up).otherwise(path).alias("path"), "text")


_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
_SPLIT = lambda x: "list_filter(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}'), lambda t: t NOT IN ({}))".format(x, TERMS, ", ".join(f"'{w}'" for w in STOP))
#: Without the cue words: every unit of every document is scored.
ORACLE = f"""
WITH templates(template, license, text) AS (VALUES {_VALUES}
), template_terms AS (
  SELECT template, license, t AS term, count(*) AS tf FROM templates, unnest({_SPLIT("text")}) AS u(t) GROUP BY ALL
), idf AS (
  SELECT term, (ln((1 + {len(TEMPLATES)}) / (1 + count(*))) + 1) / CASE WHEN term[1] <= '9' THEN 2 ELSE 1 END AS weight FROM template_terms GROUP BY term
), vectors AS (
  SELECT template, license, term, tf * weight / sqrt(sum((tf * weight) * (tf * weight)) OVER (PARTITION BY template)) AS share FROM template_terms JOIN idf USING (term)
), files AS (
  SELECT doc_id, source || '/' || lang || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '/' || doc_id % 4 || '/' || doc_id // 4 % 3 END AS dir, text FROM documents
), lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM files
), units AS (
  SELECT doc_id, 0 AS lines, 0 AS line, text AS unit FROM files
  UNION ALL
  SELECT doc_id, n, i, array_to_string(l[i:i + n - 1], chr(10)) FROM lines, unnest(range(1, {RUN + 1})) AS a(n), unnest(range(1, len(l) - n + 2)) AS b(i)
), counted AS (
  SELECT doc_id, lines, line, t AS term, count(*) AS tf FROM units, unnest({_SPLIT("unit")}) AS u(t) GROUP BY ALL
), weighed AS (
  SELECT doc_id, lines, line, term, tf * coalesce(weight, (ln(1.0 + {len(TEMPLATES)}) + 1) / CASE WHEN term[1] <= '9' THEN 2 ELSE 1 END) AS w FROM counted LEFT JOIN idf USING (term)
), norms AS (
  SELECT doc_id, lines, line, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL
), cosines AS (
  SELECT doc_id, lines, line, license, round(sum(w * share) / norm, 6) AS score FROM weighed JOIN vectors USING (term) JOIN norms USING (doc_id, lines, line) GROUP BY doc_id, lines, line, template, license, norm
), found AS (
  SELECT * FROM cosines WHERE score >= {THRESHOLD}
), own AS (
  SELECT doc_id, license AS own_license, score AS own_score, whole FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lines <> 0, score DESC, license) AS k, max(lines = 0) OVER (PARTITION BY doc_id) AS whole FROM found) WHERE k = 1
), marked AS (
  SELECT files.*, own_license, own_score, coalesce(whole, false) AS is_license_file FROM files LEFT JOIN own USING (doc_id)
), licensed AS (
  SELECT dir AS above, own_license AS given FROM (SELECT dir, own_license, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, own_license) AS r FROM marked WHERE is_license_file GROUP BY dir, own_license) WHERE r = 1
), near AS (
  SELECT dir, arg_max(above, length(above)) AS above, arg_max(given, length(above)) AS given FROM (SELECT DISTINCT dir FROM marked) JOIN licensed ON dir = above OR starts_with(dir, above || '/') GROUP BY dir
)
SELECT doc_id, dir || '/' || doc_id || '.txt' AS path, own_license, own_score, is_license_file, coalesce(own_license, given) AS license,
       CASE WHEN own_license IS NULL THEN near.above END AS inherited_from
FROM marked LEFT JOIN near USING (dir)
"""
