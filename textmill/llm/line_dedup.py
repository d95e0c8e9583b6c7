"""Removal of repeated passages by windows of three lines (operator 9), DataFrame functions only.

A text is cut at line feeds. Every run of three consecutive lines is a window, keyed by 128
bits over the hashes of its lines. A window that occurs elsewhere stays only in its first
occurrence, by (doc_id, hash of the text, row, position); the lines that its later occurrences
cover are removed, overlapping ones merged. Lines are compared as they are, blanks included.

Scale: rows are written once with a key of their own, so that rows which share an id stay apart.
Windows are counted with a map-side combine, and only those whose key repeats are joined again.
They are written before that join: both its sides are then plain shuffles, which Spark splits where a key is hot;
with the aggregate between them it would not. Texts are shuffled once, next to the list of lines to remove.

Edge cases: a null text is kept null and has no lines; a very long text is one row, as are its windows' keys; texts of fewer than three lines are
kept whole; a text may repeat itself; rows that share a doc_id are documents of their own, of
equal ones (id and text) any one counts as the first; a null doc_id comes first; a document
whose lines all go is kept with an empty text; an empty table gives an empty result. All other
columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.storage import materialize

WINDOW = 3


def repeated_windows(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """``rows`` (key, text) -> (key, pos) of every window but the first of its kind."""
    lines = rows.select("key", F.transform(F.split("text", "\n"), lambda x: F.md5(x)).alias("hashes")).where(F.size("hashes") >= size)
    hashes = F.transform(F.sequence(F.lit(0), F.size("hashes") - size), lambda i: F.unhex(F.md5(F.array_join(F.slice(F.col("hashes"), i + 1, size), ""))))
    windows = lines.select("key", F.posexplode(hashes).alias("pos", "window"))
    repeated = windows.groupBy("window").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("window", "first")
    repeated = materialize(repeated, "line-windows")
    return windows.join(repeated, "window").where(~F.struct("key", "pos").eqNullSafe(F.col("first"))).select("key", "pos")


def dedup_lines(docs: DataFrame, size: int = WINDOW, details: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with later occurrences of repeated windows cut out of ``text``.
    With ``details`` the result is doc_id, n_lines, n_removed and the new text instead."""
    text = F.col("text").cast("string")
    key = F.struct("doc_id", F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    # The columns are put in a struct, so that no name of theirs meets one of the plan.
    rows = materialize(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key")), "line-rows")
    text = F.col("row.text").cast("string")
    covered = repeated_windows(rows.select("key", text.alias("text")), size).groupBy("key").agg(F.collect_set("pos").alias("starts"))
    removed = covered.select("key", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + size - 1)))).alias("removed"))
    # place alone tells rows apart and is never null, unlike the id
    joined = rows.join(removed.select(F.col("key.place").alias("of"), "removed"), F.col("key.place") == F.col("of"), "left")
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    if details:
        return joined.select("row.doc_id", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), text.alias("text"))
    return joined.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


ORACLE = """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, p - 1 AS pos, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS k
  FROM lines, unnest(range(1, len(l) - 1)) AS u(p)
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM windows) WHERE r > 1
), removed AS (
  SELECT DISTINCT doc_id, pos + d AS line FROM later, unnest(range(0, 3)) AS u(d)
), gone AS (
  SELECT doc_id, list(line) AS r FROM removed GROUP BY doc_id
)
SELECT doc_id, len(l)::INT AS n_lines, coalesce(len(r), 0)::INT AS n_removed,
       md5(CASE WHEN r IS NULL THEN array_to_string(l, chr(10)) ELSE array_to_string([x FOR x, i IN l IF NOT list_contains(r, i - 1)], chr(10)) END) AS text_md5
FROM lines LEFT JOIN gone USING (doc_id)
"""
