"""DuckDB SQL with the results of the chunking strategies, composed like the strategies.

Every function takes the name of a relation (doc_id, text) and gives a query of (doc_id, ord,
suffix, text, metadata).
"""

from __future__ import annotations

from collections.abc import Callable

from textmill.functions import text as T

Sql = Callable[[str], str]
TOKENS = f"regexp_extract_all(text, '{T.TOKENS}')"


def sentences(end: str = T.SENTENCE_END) -> str:
    return f"list_filter(string_split(regexp_replace(text, '{end}', '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '')"


PARAGRAPHS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^{T.BLANKS}+|{T.BLANKS}+$', '', 'g')), lambda x: x <> '')"
SENTENCES = sentences()
_WORDS = lambda x: f"regexp_extract_all({x}, '{T.WORDS}')"


def windows(units: str, size: int, step: int, joiner: str, name: str, keys: str, ends: tuple[str, str], kind: str = "chunk") -> Sql:
    return lambda src: f"""
SELECT doc_id, s // {step} AS ord, format('_{kind}_{{:04d}}', s // {step}) AS suffix, array_to_string(u[s + 1:s + {size}], {joiner}) AS text,
       json_object('chunker', '{name}', {keys}, '{ends[0]}', s, '{ends[1]}', least(s + {size}, len(u)))::VARCHAR AS metadata
FROM (SELECT doc_id, {units} AS u FROM {src}), unnest(range(0, len(u), {step})) AS t(s)"""


def each_unit(units: str, name: str, index: str, total: str = "", kind: str = "chunk") -> Sql:
    more = f", '{total}', len(u)" if total else ""
    return lambda src: f"""
SELECT doc_id, i AS ord, format('_{kind}_{{:04d}}', i) AS suffix, u[i + 1] AS text, json_object('chunker', '{name}', '{index}', i{more})::VARCHAR AS metadata
FROM (SELECT doc_id, {units} AS u FROM {src}), unnest(range(0, len(u))) AS t(i)"""


def fixed_character(size: int, overlap: int) -> Sql:
    step = max(1, size - overlap)
    return lambda src: f"""
SELECT doc_id, s // {step} AS ord, format('_chunk_{{:04d}}', s // {step}) AS suffix, substring(text, s + 1, {size}) AS text,
       json_object('chunker', 'fixed_character_chunking', 'chunk_size', {size}, 'overlap', {overlap}, 'start_char', s, 'end_char', least(s + {size}, length(text)))::VARCHAR AS metadata
FROM {src}, unnest(range(0, length(text), {step})) AS t(s)"""


def _from_starts(joiner: str, metadata: str) -> str:
    """From ``st`` (doc_id, u, cuts, ...): pieces from each start to the next; ``metadata`` may use i, a, b and text."""
    return f"""
SELECT doc_id, i AS ord, format('_chunk_{{:04d}}', i) AS suffix, text, ({metadata})::VARCHAR AS metadata
FROM (SELECT *, cuts[i + 1] AS a, coalesce(cuts[i + 2], len(u)) AS b, array_to_string(u[cuts[i + 1] + 1:coalesce(cuts[i + 2], len(u))], {joiner}) AS text
      FROM st, unnest(range(0, len(cuts))) AS t(i))"""


def _greedy(units: str, limit: str, metadata: str) -> Sql:
    return lambda src: f"""
WITH RECURSIVE un AS (SELECT doc_id, {units} AS u FROM {src}
), g(doc_id, u, i, len, cuts) AS (
  SELECT doc_id, u, 1, length(u[1]), [0] FROM un WHERE len(u) > 0
  UNION ALL
  SELECT doc_id, u, i + 1, CASE WHEN len + length(x) > lim THEN length(x) ELSE len + length(x) END, CASE WHEN len + length(x) > lim THEN list_append(cuts, i) ELSE cuts END
  FROM (SELECT *, u[i + 1] AS x, {limit} AS lim FROM g WHERE i < len(u))
), st AS (SELECT doc_id, u, cuts FROM g WHERE i = len(u)
) {_from_starts("' '", metadata)}"""


def length_aware(target: int, tolerance: int) -> Sql:
    return _greedy(SENTENCES, str(target + tolerance), "json_object('chunker', 'length_aware_chunking', 'length', length(text))")


def treebank_words(x: str) -> str:
    for pattern, put in T.TREEBANK:
        if pattern.endswith(" ") or pattern == T.TREEBANK[-1][0]:
            x = f"(' ' || {x} || ' ')"
        quoted = [v.replace("'", "''") for v in (pattern, put)]
        x = f"regexp_replace({x}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return f"list_filter(string_split_regex({x}, '[ \\t-\\r]+'), lambda w: w <> '')"


def content_density(base: int, words: Callable[[str], str] = lambda x: f"regexp_extract_all({x}, '{T.WORDS}')") -> Sql:
    _WORDS = words
    factor = lambda x: f"(1.5::DOUBLE - len(list_distinct({_WORDS(x)}))::DOUBLE / len({_WORDS(x)}))"
    closing = factor("u[cuts[i + 2] + 1]")
    meta = f"CASE WHEN cuts[i + 2] IS NULL THEN json_object('chunker', 'content_density_adaptive_chunking') ELSE json_object('chunker', 'content_density_adaptive_chunking', 'density_factor', round({closing}, 6)) END"
    return _greedy(f"list_filter({SENTENCES}, lambda x: len({_WORDS('x')}) > 0)", f"{factor('u[i + 1]')} * {base}", meta)


def dynamic_token(low: int, high: int) -> Sql:
    return lambda src: f"""
WITH RECURSIVE un AS (SELECT doc_id, {TOKENS} AS u FROM {src}
), en AS (SELECT doc_id, u, list_filter(range(1, len(u) + 1), lambda i: regexp_matches(u[i], '[.\\n?!]')) AS ends FROM un WHERE len(u) > 0
), g(doc_id, u, ends, s, cuts) AS (
  SELECT doc_id, u, ends, 0::BIGINT, []::BIGINT[] FROM en
  UNION ALL
  SELECT doc_id, u, ends, coalesce(list_max(list_filter(ends, lambda e: e > least(s + {low}, len(u)) AND e <= least(s + {high}, len(u)))), least(s + {high}, len(u))), list_append(cuts, s) FROM g WHERE s < len(u)
), st AS (SELECT doc_id, u, cuts FROM g WHERE s >= len(u)
) {_from_starts("''", "json_object('chunker', 'dynamic_token_size_chunking', 'token_count', b - a)")}"""


def _similar(src: str, units: str, reach: int) -> str:
    """CTEs up to ``si`` (doc_id, whole, u, v): cosines of the word counts of neighbours."""
    bag = "w[i]" if not reach else f"flatten(w[greatest(1, i - {reach}):i + {reach}])"
    dot = lambda a, b: f"list_sum(list_transform({a}, lambda x: len(list_filter({b}, lambda y: y = x))))"
    return f"""
un AS (SELECT doc_id, text AS whole, {units} AS u FROM {src}
), bags AS (SELECT doc_id, i, {bag} AS bag FROM (SELECT doc_id, list_transform(u, lambda x: {_WORDS('x')}) AS w FROM un), unnest(range(1, len(w) + 1)) AS t(i)
), sq AS (SELECT doc_id, i, bag, coalesce({dot('bag', 'bag')}, 0) AS n FROM bags
), co AS (SELECT a.doc_id, a.i, CASE WHEN a.n * b.n = 0 THEN 0.0::DOUBLE ELSE round(coalesce({dot('a.bag', 'b.bag')}, 0)::DOUBLE / sqrt((a.n * b.n)::DOUBLE), 9) END AS c FROM sq a JOIN sq b ON a.doc_id = b.doc_id AND b.i = a.i + 1
), si AS (SELECT un.doc_id, whole, u, coalesce(v, []) AS v FROM un LEFT JOIN (SELECT doc_id, list(c ORDER BY i) AS v FROM co GROUP BY doc_id) USING (doc_id) WHERE len(u) > 0
)"""


def _cut(values: str, condition: str) -> str:
    return f"list_concat([0], list_filter(range(1, len({values}) + 1), lambda i: coalesce({condition}, false)))"


def similarity_threshold(threshold: float) -> Sql:
    meta = f"json_object('chunker', 'semantic_similarity_threshold_chunking', 'threshold', {threshold}, 'sentence_count', b - a)"
    return lambda src: f"WITH {_similar(src, SENTENCES, 0)}, st AS (SELECT doc_id, u, {_cut('v', f'v[i] < {threshold}')} AS cuts FROM si) {_from_starts(chr(39) + ' ' + chr(39), meta)}"


def semantic_variance(sensitivity: float) -> Sql:
    name = "'chunker', 'semantic_variance_adaptive_chunking'"
    condition = f"i > 1 AND round(v[i] - list_reduce(list_concat([0.0::DOUBLE], v[greatest(1, i - 3):i - 1]), lambda a, x: a + x) / least(i - 1, 3) + {sensitivity}::DOUBLE, 9) < 0"
    meta = f"CASE WHEN cuts[i + 2] IS NULL THEN json_object({name}) ELSE json_object({name}, 'split_score', round(v[cuts[i + 2]], 6)) END"
    return lambda src: f"""WITH {_similar(src, SENTENCES, 0)}, st AS (SELECT doc_id, CASE WHEN len(u) = 1 THEN [whole] ELSE u END AS u, v, {_cut('v', condition)} AS cuts FROM si) {_from_starts("' '", meta)}"""


def semantic_breakpoints(name: str, gradient: bool = False) -> Sql:
    slope = "round(CASE WHEN i = 1 THEN d[2] - d[1] WHEN i = len(d) THEN d[i] - d[i - 1] ELSE (d[i + 1] - d[i - 1]) / 2 END, 9)"
    values = f"list_transform(range(1, len(d) + 1), lambda i: {slope})" if gradient else "d"
    least = 2 if gradient else 1
    return lambda src: f"""WITH {_similar(src, sentences(T.PLAIN_SENTENCE_END), 1)}
, di AS (SELECT doc_id, u, list_transform(v, lambda x: round(1 - x, 9)) AS d FROM si
), va AS (SELECT doc_id, u, {values} AS g FROM di
), th AS (SELECT doc_id, u, g, round(list_aggregate(g, 'quantile_cont', 0.95), 9) AS top FROM va
), st AS (SELECT doc_id, u, CASE WHEN len(u) > {least} THEN {_cut('g', 'g[i] > top')} ELSE [0] END AS cuts FROM th
) {_from_starts("' '", f"json_object('chunker', '{name}')")}"""


def llm_boundary(most: int, overlap: int) -> Sql:
    """Sentences one after another, with a null at the end of each paragraph; ``run`` and ``wait`` are what is gathered."""
    strip = lambda x: f"regexp_replace({x}, '^{T.BLANKS}+|{T.BLANKS}+$', '', 'g')"
    add = lambda x: f"list_append(out, {strip(x)})"
    marked = "string_split(regexp_replace(p, '([.!?…]+\\s+)', '\\1' || chr(31), 'g'), chr(31))"
    meta = "json_object('chunker', 'hybrid_boundary_chunker', 'char_count', length(text), 'used_llm_refinement', false, 'chunk_index', i)"
    return lambda src: f"""
WITH RECURSIVE te AS (SELECT doc_id, {strip("regexp_replace(text, chr(13) || chr(10) || '|' || chr(13), chr(10), 'g')")} AS text FROM {src}
), ev AS (SELECT doc_id, flatten(list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {strip("p")} <> ''), lambda p: list_append({marked}[:-2], NULL))) AS ev FROM te
), g(doc_id, ev, k, run, wait, out) AS (
  SELECT doc_id, ev, 0, '', '', []::VARCHAR[] FROM ev
  UNION ALL
  SELECT doc_id, ev, k + 1,
    CASE WHEN x IS NULL THEN '' WHEN length(run) + length(x) <= {most} THEN run || x ELSE x END,
    CASE WHEN x IS NOT NULL OR run = '' THEN wait WHEN length(wait) + length(run) > {most} OR wait = '' THEN run ELSE wait || chr(10) || chr(10) || run END,
    CASE WHEN x IS NOT NULL AND length(run) + length(x) > {most} AND run <> '' THEN {add("run")} WHEN x IS NULL AND run <> '' AND wait <> '' AND length(wait) + length(run) > {most} THEN {add("wait")} ELSE out END
  FROM (SELECT *, ev[k + 1] AS x FROM g WHERE k < len(ev))
), ch AS (SELECT doc_id, CASE WHEN wait <> '' THEN {add("wait")} ELSE out END AS c FROM g WHERE k = len(ev)
)
SELECT doc_id, i AS ord, format('_chunk_{{:04d}}', i) AS suffix, text, ({meta})::VARCHAR AS metadata
FROM (SELECT doc_id, i, CASE WHEN i = 0 THEN c[1] ELSE right(c[i], {overlap}) || chr(10) || chr(10) || c[i + 1] END AS text FROM ch, unnest(range(0, len(c))) AS t(i))"""


def llm_segment(most: int, overlap: int) -> Sql:
    """Blocks are cut at the last sentence mark in reach, part after part; then each chunk takes the end of the last one."""
    strip = lambda x: f"regexp_replace({x}, '^{T.BLANKS}+|{T.BLANKS}+$', '', 'g')"
    kind = f"CASE WHEN starts_with({strip('b')}, '```') THEN 'code' WHEN regexp_matches({strip('b')}, '^#{{1,6}}\\s+') THEN 'heading_block' WHEN regexp_matches({strip('b')}, '^(-|\\*|[0-9]+\\.)\\s+') THEN 'list' ELSE 'paragraph' END"
    meta = "json_object('chunker', 'efficient_llm_segment_then_chunk', 'unit_type', kind, 'chunk_index', i, 'char_count', length(out))"
    return lambda src: f"""
WITH RECURSIVE te AS (SELECT doc_id, {strip("regexp_replace(regexp_replace(text, chr(13) || chr(10) || '|' || chr(13), chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM {src}
), bl AS (SELECT doc_id, n, b, {kind} AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS b, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM te) WHERE {strip("b")} <> ''
), en AS (SELECT *, list_filter(range(1, length(b) + 1), lambda i: b[i] IN ('.', '!', '?', '…')) AS ends FROM bl
), g(doc_id, n, kind, b, ends, s, e) AS (
  SELECT doc_id, n, kind, b, ends, 0::BIGINT, CASE WHEN length(b) <= {most} THEN length(b) ELSE coalesce(list_max(list_filter(ends, lambda e: e <= {most})), {most}) END FROM en
  UNION ALL
  SELECT doc_id, n, kind, b, ends, e, coalesce(list_max(list_filter(ends, lambda x: x > e AND x <= e + {most})), least(e + {most}, length(b))) FROM g WHERE e < length(b)
), pa AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, s) - 1 AS i, kind, b[s + 1:e] AS part FROM g
), ov(doc_id, i, kind, out) AS (
  SELECT doc_id, i, kind, part FROM pa WHERE i = 0
  UNION ALL
  SELECT pa.doc_id, pa.i, pa.kind, right(ov.out, {overlap}) || chr(10) || chr(10) || part FROM ov JOIN pa ON pa.doc_id = ov.doc_id AND pa.i = ov.i + 1
)
SELECT doc_id, i AS ord, format('_chunk_{{:04d}}', i) AS suffix, out AS text, ({meta})::VARCHAR AS metadata FROM ov"""


def hybrid(primary: Sql, secondary: Sql, most: int = 1000) -> Sql:
    return lambda src: f"""
WITH pr AS (SELECT * FROM ({primary(src)})
), lo AS (SELECT doc_id || '|' || suffix AS doc_id, text FROM pr WHERE length(text) > {most}
), se AS (SELECT * FROM ({secondary('lo')})
), al AS (
  SELECT doc_id, ord AS o1, 0 AS o2, suffix, '' AS within, text, metadata FROM pr WHERE length(text) <= {most}
  UNION ALL
  SELECT p.doc_id, p.ord, se.ord, p.suffix || se.suffix, p.suffix, se.text, se.metadata FROM pr p JOIN se ON se.doc_id = p.doc_id || '|' || p.suffix
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o1, o2) - 1 AS ord, suffix, within, text, metadata FROM al"""


def _tokens(size: int, step: int, name: str, keys: str, kind: str = "chunk") -> Sql:
    return windows(TOKENS, size, step, "''", name, keys, ("start_token", "end_token"), kind)


FIXED_200 = _tokens(200, 180, "fixed_token_chunking", "'chunk_size', 200, 'overlap', 20")
SLIDING = _tokens(50, 25, "sliding_window_token_chunking", "'window_size', 50, 'step_size', 25")
OVERLAPPING = _tokens(50, 40, "overlapping_token_chunking", "'chunk_size', 50, 'overlap_size', 10")
SENTENCE = each_unit(SENTENCES, "sentence_based_chunking", "sentence_index")
SENTENCE_GROUP = windows(SENTENCES, 3, 2, "' '", "sentence_group_chunking", "'sentences_per_chunk', 3, 'overlap', 1", ("start_sentence_index", "end_sentence_index"))
PARAGRAPH = each_unit(PARAGRAPHS, "paragraph_based_chunking", "paragraph_index")
PARAGRAPH_GROUP = windows(PARAGRAPHS, 2, 1, "chr(10) || chr(10)", "paragraph_group_chunking", "'paragraphs_per_chunk', 2, 'overlap', 1", ("start_paragraph_index", "end_paragraph_index"))
SEMANTIC = semantic_breakpoints("semantic_embedding_based_chunking")

STRATEGIES: dict[str, Sql] = {
    "fixed_character_chunking": fixed_character(100, 10),
    "fixed_token_chunking": _tokens(50, 50, "fixed_token_chunking", "'chunk_size', 50, 'overlap', 0"),
    "sliding_window_token_chunking": SLIDING,
    "overlapping_token_chunking": OVERLAPPING,
    "sentence_based_chunking": SENTENCE,
    "sentence_group_chunking": SENTENCE_GROUP,
    "paragraph_based_chunking": PARAGRAPH,
    "paragraph_group_chunking": PARAGRAPH_GROUP,
    "semantic_embedding_based_chunking": SEMANTIC,
    "semantic_similarity_threshold_chunking": similarity_threshold(0.6),
    "semantic_boundary_detection": semantic_breakpoints("semantic_boundary_detection", True),
    "late_chunking_sentence_indexing": each_unit(SENTENCES, "late_chunking_sentence_indexing", "sentence_index", "total_sentences", "sent"),
    "late_chunking_paragraph_indexing": each_unit(PARAGRAPHS, "late_chunking_paragraph_indexing", "paragraph_index", "total_paragraphs", "para"),
    "late_chunking_token_spans": _tokens(128, 64, "late_chunking_token_spans", "'span_size', 128, 'step_size', 64", "span"),
    "dynamic_token_size_chunking": dynamic_token(50, 200),
    "content_density_adaptive_chunking": content_density(1000),
    "semantic_variance_adaptive_chunking": semantic_variance(0.2),
    "length_aware_chunking": length_aware(500, 100),
    "llm_boundary_detection_chunking": llm_boundary(1500, 80),
    "llm_segment_then_chunk": llm_segment(1500, 80),
    "hybrid_semantic_fixed_token_chunking": hybrid(SEMANTIC, FIXED_200),
    "hybrid_semantic_sliding_window_chunking": hybrid(SEMANTIC, SLIDING),
    "hybrid_sentence_fixed_token_chunking": hybrid(SENTENCE, FIXED_200),
    "hybrid_paragraph_fixed_token_chunking": hybrid(PARAGRAPH, FIXED_200),
    "hybrid_fixed_char_fixed_token_chunking": hybrid(fixed_character(100, 10), FIXED_200),
    "hybrid_overlapping_fixed_token_chunking": hybrid(OVERLAPPING, FIXED_200),
    "hybrid_sentence_group_fixed_token_chunking": hybrid(SENTENCE_GROUP, FIXED_200),
    "hybrid_paragraph_group_fixed_token_chunking": hybrid(PARAGRAPH_GROUP, FIXED_200),
    "hybrid_dynamic_fixed_token_chunking": hybrid(dynamic_token(50, 200), FIXED_200),
    "hybrid_content_density_fixed_token_chunking": hybrid(content_density(1000), FIXED_200),
    "hybrid_semantic_variance_fixed_token_chunking": hybrid(semantic_variance(0.2), FIXED_200),
}


#: Beside the configured strategies: those of the catalogue's ``MORE`` that SQL can state.
HYBRIDS: dict[str, Sql] = {
    "content_density_treebank_chunking": content_density(1000, treebank_words),
    "hybrid_length_aware_semantic_chunking": hybrid(length_aware(2000, 200), SEMANTIC),
    "hybrid_fixed_char_similarity_chunking": hybrid(fixed_character(1500, 0), similarity_threshold(0.3)),
    "hybrid_sentence_group_variance_chunking": hybrid(windows(SENTENCES, 9, 8, "' '", "sentence_group_chunking", "'sentences_per_chunk', 9, 'overlap', 1", ("start_sentence_index", "end_sentence_index")), semantic_variance(0.2), 300),
}


def documents(paragraphs: bool) -> str:
    text = "replace(text, chr(10), chr(10) || chr(10))" if paragraphs else "text"
    return f"(SELECT format('doc_{{:03d}}', doc_id) AS doc_id, {text} AS text FROM documents)"


def strategy(name: str, of: dict[str, Sql] = STRATEGIES) -> str:
    """SQL for the registered query of a strategy."""
    made = of[name](documents("paragraph" in name or name.startswith("llm")))
    within = "within" if name.startswith("hybrid") else "''"
    return f"SELECT doc_id || {within} AS doc_id, ord::INT AS chunk_ord, doc_id || suffix AS chunk_id, text, metadata FROM ({made})"
