"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from gritstone.functions.text import ALIASES
from gritstone.operators.prompts import INSTRUCTIONS

_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
_SENT = r"(?s).+?(?:[.!?]\s+|\z)"
_FRAG = r"(?:\A\s*)?(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])\s*"


def _tokens(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{_TOKEN}'))"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\s+$', '')"


def _bare(c: str) -> str:
    return rf"upper(trim(regexp_replace(trim({c}), ':\s*$', '')))"


def _caps(c: str) -> str:
    return rf"(regexp_matches({c}, '\p{{Lu}}') AND NOT regexp_matches({c}, '\p{{Ll}}') AND NOT regexp_matches(trim({c}), '[.!?;]$'))"


_NAMES = ", ".join(f"'{a}'" for a in ALIASES)
_ALIAS_CASE = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE {0} END"


def _heading(c: str) -> str:
    return (
        rf"(length(trim({c})) BETWEEN 3 AND 80 AND regexp_matches(trim({c}), '\p{{L}}') AND NOT regexp_matches(trim({c}), '^[0-9]')"
        rf" AND ({_caps(c)} OR regexp_matches({c}, ':\s*$') OR {_bare(c)} IN ({_NAMES})))"
    )


def _fragments(c: str) -> str:
    return (
        f"list_transform(range(0, greatest(1, CAST(ceil(len(regexp_extract_all({c}, '{_FRAG}')) / 256.0) AS BIGINT))),"
        f" lambda i: array_to_string(regexp_extract_all({c}, '{_FRAG}')[i * 256 + 1 : i * 256 + 256], ''))"
    )


PATENTS = """
pl AS (SELECT doc_id, lang, source, ls, len(ls) AS n, unnest(ls) AS line, unnest(range(0, len(ls))) AS i
       FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
patents AS (
  SELECT 'US' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS patent_id, any_value(lang) AS lang, any_value(source) AS source,
    string_agg(CASE WHEN i = 0 THEN 'ABSTRACT' || chr(10) WHEN i = 1 AND n > 3 THEN 'BACKGROUND OF THE INVENTION' || chr(10)
      WHEN i = 2 AND n > 4 THEN 'Detailed Description:' || chr(10) WHEN i = n - 1 AND n > 1 THEN 'CLAIMS' || chr(10) ELSE '' END || line,
      chr(10) ORDER BY i) AS text
  FROM pl GROUP BY doc_id),
lines AS (SELECT patent_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM patents)
"""
SECTIONS = (
    PATENTS
    + f""",
al AS (SELECT *, {_heading('line')} AS is_heading FROM lines),
asg AS (SELECT *, CAST(sum(CAST(is_heading AS INTEGER)) OVER w AS INTEGER) AS section_idx,
    coalesce(last_value(CASE WHEN is_heading THEN {_ALIAS_CASE.format(_bare('line'))} END IGNORE NULLS) OVER w, 'PREAMBLE') AS section,
    CAST(sum(length(line) + 1) OVER w - length(line) - 1 AS INTEGER) AS line_start
  FROM al WINDOW w AS (PARTITION BY patent_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
sections AS (SELECT patent_id, section_idx, section, string_agg(line, chr(10) ORDER BY line_no) AS body, min(line_start) AS body_start
  FROM asg WHERE NOT is_heading GROUP BY ALL)
"""
)
_PARA = r"(?s).+?(?:\n|\z)"
UNITS = (
    SECTIONS
    + rf""",
up AS (SELECT patent_id, section_idx, section, body_start, unnest(parts) AS piece, unnest(range(0, len(parts))) AS p
  FROM (SELECT *, regexp_extract_all(body, '{_PARA}') AS parts FROM sections)),
up2 AS (SELECT *, body_start + coalesce(sum(length(piece)) OVER (PARTITION BY patent_id, section_idx ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
  {_tokens('piece')} <= 256 AS fits FROM up),
us AS (SELECT * EXCLUDE (piece, parts, place), place AS p_at, unnest(parts) AS piece, unnest(range(0, len(parts))) AS s
  FROM (SELECT *, CASE WHEN fits THEN [piece] ELSE regexp_extract_all(piece, '{_SENT}') END AS parts FROM up2)),
us2 AS (SELECT *, p_at + coalesce(sum(length(piece)) OVER (PARTITION BY patent_id, section_idx, p ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
  {_tokens('piece')} <= 256 AS fits_s FROM us),
uf AS (SELECT * EXCLUDE (piece, parts, place), place AS s_at, unnest(parts) AS piece, unnest(range(0, len(parts))) AS f
  FROM (SELECT *, CASE WHEN fits_s THEN [piece] ELSE {_fragments('piece')} END AS parts FROM us2)),
uf2 AS (SELECT *, s_at + coalesce(sum(length(piece)) OVER (PARTITION BY patent_id, section_idx, p, s ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM uf),
units AS MATERIALIZED (
  SELECT patent_id, section_idx, section, CAST(row_number() OVER (PARTITION BY patent_id, section_idx ORDER BY p, s, f) - 1 AS INTEGER) AS unit_idx,
    CASE WHEN fits THEN 'paragraph' WHEN fits_s THEN 'sentence' ELSE 'fragment' END AS kind, {_strip('piece')} AS text,
    CAST({_tokens(_strip('piece'))} AS INTEGER) AS token_count, CAST(place AS INTEGER) AS start_offset, CAST(place + length({_strip('piece')}) AS INTEGER) AS end_offset
  FROM uf2 WHERE length({_strip('piece')}) > 0)
"""
)


def _chunks(overlap: str = "last_sentence", prefix: str = "") -> str:
    """CTEs up to ``{prefix}chunks``, from ``units``."""
    tail = {"last_sentence": _strip(f"coalesce(regexp_extract_all(text, '{_SENT}')[-1], '')"), "last_unit": "text", "none": "''"}[overlap]
    x = prefix
    return rf""",
{x}ut AS MATERIALIZED (SELECT *, CAST({_tokens('tail')} AS INTEGER) AS tail_tokens FROM (SELECT *, {tail} AS tail FROM units)),
{x}fold AS (
  SELECT patent_id, section_idx, unit_idx, 0 AS chunk_no, token_count AS size, 0 AS overlap, tail_tokens AS carry FROM {x}ut WHERE unit_idx = 0
  UNION ALL
  SELECT u.patent_id, u.section_idx, u.unit_idx,
    CASE WHEN f.size + u.token_count <= 256 THEN f.chunk_no ELSE f.chunk_no + 1 END,
    CASE WHEN f.size + u.token_count <= 256 THEN f.size + u.token_count WHEN f.carry + u.token_count <= 256 THEN f.carry + u.token_count ELSE u.token_count END,
    CASE WHEN f.size + u.token_count <= 256 THEN f.overlap WHEN f.carry + u.token_count <= 256 THEN f.carry ELSE 0 END,
    u.tail_tokens
  FROM {x}fold f JOIN {x}ut u ON u.patent_id = f.patent_id AND u.section_idx = f.section_idx AND u.unit_idx = f.unit_idx + 1),
{x}grouped AS (SELECT patent_id, section_idx, any_value(section) AS section, chunk_no, min(unit_idx) AS first_unit, CAST(count(*) AS INTEGER) AS unit_count, min(overlap) AS overlap_tokens,
    string_agg(text, ' ' ORDER BY unit_idx) AS own, arg_min(start_offset, unit_idx) AS own_start, max(end_offset) AS end_offset
  FROM {x}fold JOIN {x}ut USING (patent_id, section_idx, unit_idx) GROUP BY patent_id, section_idx, chunk_no),
{x}chunks AS MATERIALIZED (SELECT patent_id, section_idx, section, chunk_no, patent_id || '::' || section_idx || '::' || chunk_no AS chunk_id, text, first_unit, unit_count, overlap_tokens,
    CAST({_tokens('text')} AS INTEGER) AS token_count, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS word_count, start_offset, end_offset
  FROM (SELECT g.*, CASE WHEN overlap_tokens > 0 THEN b.tail || ' ' || own ELSE own END AS text,
      CAST(CASE WHEN overlap_tokens > 0 THEN b.end_offset - length(b.tail) ELSE own_start END AS INTEGER) AS start_offset
    FROM {x}grouped g LEFT JOIN {x}ut b ON b.patent_id = g.patent_id AND b.section_idx = g.section_idx AND b.unit_idx = g.first_unit - 1))
"""


CHUNKS = UNITS + _chunks()
JUDGED = (
    CHUNKS
    + rf""",
jn AS (SELECT * REPLACE (trim(regexp_replace(text, '\s+', ' ', 'g')) AS text) FROM chunks),
jt AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS toks FROM jn),
jl AS (SELECT *, lag(toks) OVER (PARTITION BY patent_id, section_idx ORDER BY chunk_no) AS prev FROM jt),
jr AS (SELECT * EXCLUDE (toks, prev, token_count, word_count), CAST({_tokens('text')} AS INTEGER) AS token_count,
    coalesce(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / CAST(nullif(length(text), 0) AS DOUBLE), 0) AS alpha_ratio,
    CASE WHEN prev IS NOT NULL THEN len(list_filter(toks, lambda x: NOT list_contains(prev, x))) / CAST(nullif(len(toks), 0) AS DOUBLE) END AS novelty,
    row_number() OVER (PARTITION BY patent_id, text ORDER BY section_idx, chunk_no) AS copy_no FROM jl),
judged AS MATERIALIZED (SELECT *, CASE WHEN {_heading('text')} THEN 'heading_only' WHEN alpha_ratio < 0.30 THEN 'low_information'
    WHEN novelty < 0.10 THEN 'degenerate_overlap' WHEN token_count < 20 THEN 'too_short' WHEN copy_no > 1 THEN 'duplicate' END AS reject_reason FROM jr),
valid AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY patent_id, section_idx ORDER BY chunk_no) - 1 AS INTEGER) AS section_chunk_index,
    CAST(row_number() OVER (PARTITION BY patent_id ORDER BY section_idx, chunk_no) - 1 AS INTEGER) AS document_chunk_index,
    CAST(count(*) OVER (PARTITION BY patent_id) AS INTEGER) AS total_chunks FROM judged WHERE reject_reason IS NULL)
"""
)


def _embedded(source: str, key: str, name: str) -> str:
    return rf""",
{name} AS MATERIALIZED (SELECT {key}, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS weight FROM (
  SELECT {key}, bucket, CAST(count(*) AS DOUBLE) AS n FROM (
    SELECT {key}, CAST('0x' || substr(md5(w), 1, 6) AS INTEGER) % 64 AS bucket
    FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM {source})) GROUP BY ALL))
"""


HITS = (
    JUDGED
    + _embedded("valid", "chunk_id", "cv")
    + _embedded("benchmark", "item_id", "qv")
    + """,
scored AS (SELECT q.item_id AS query_id, chunk_id, round(coalesce(s, 0), 6) AS vector_score
  FROM (SELECT item_id FROM benchmark) q CROSS JOIN (SELECT chunk_id FROM valid) c
  LEFT JOIN (SELECT item_id, chunk_id, sum(qv.weight * cv.weight) AS s FROM qv JOIN cv USING (bucket) GROUP BY ALL) x USING (item_id, chunk_id)),
hits AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) AS INTEGER) AS vector_rank FROM scored) WHERE vector_rank <= 50),
pairs AS (SELECT h.*, b.text AS query_text, v.text, v.patent_id, v.section FROM hits h JOIN valid v USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id),
rr AS (SELECT *, list_distinct(regexp_extract_all(lower(query_text), '[\\p{L}\\p{N}]+')) AS qw, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tw FROM pairs),
rs AS (SELECT * EXCLUDE (qw, tw), round(coalesce(len(list_intersect(qw, tw)) / CAST(nullif(len(qw), 0) AS DOUBLE), 0) + 0.001 * vector_score, 6) AS rerank_score FROM rr),
top AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vector_rank, chunk_id) AS INTEGER) AS rerank_rank FROM rs) WHERE rerank_rank <= 10),
results AS (SELECT query_id, patent_id, max(rerank_score) AS score, CAST(count(*) AS INTEGER) AS chunks, arg_min(chunk_id, rerank_rank) AS best_id, arg_min(rerank_score, rerank_rank) AS best_score,
    'Patent ' || patent_id || ' (score ' || format('{:.4f}', max(rerank_score)) || ')' || chr(10) || string_agg('[' || section || ' | ' || chunk_id || ']' || chr(10) || text, chr(10) ORDER BY rerank_rank) AS block
  FROM top GROUP BY query_id, patent_id)
"""
)
_VECTORS = """
s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, r.label, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS vector_score
  FROM embeddings q CROSS JOIN embeddings r WHERE q.vec_id % 20 = 0),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, id) AS INTEGER) AS vector_rank FROM s) WHERE vector_rank <= 50)
"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()} {select}"


ORACLES: dict[str, str] = {
    "doc_lines": _with(PATENTS, "SELECT patent_id, line_no, line FROM lines"),
    "heading_lines": _with(PATENTS, rf"SELECT patent_id, line_no, line, {_caps('line')} AS caps, regexp_matches(line, ':\s*$') AS colon FROM lines WHERE {_heading('line')}"),
    "heading_aliases": _with(PATENTS, f"SELECT patent_id, line_no, {_ALIAS_CASE.format(_bare('line'))} AS section, {_bare('line')} IN ({_NAMES}) AS is_standard FROM lines WHERE {_heading('line')}"),
    "doc_sections": _with(SECTIONS, "SELECT * FROM sections"),
    "section_isolation": _with(CHUNKS, "SELECT chunk_id FROM chunks JOIN sections USING (patent_id, section_idx) WHERE start_offset < body_start OR end_offset > body_start + length(body)"),
    "paragraph_units": _with(UNITS, f"SELECT patent_id, section_idx, CAST(p AS INTEGER) AS p, {_strip('piece')} AS text FROM up"),
    "sentence_units": f"SELECT doc_id, CAST(s AS INTEGER) AS s, {_strip('piece')} AS text FROM (SELECT doc_id, unnest(l) AS piece, unnest(range(0, len(l))) AS s FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SENT}') AS l FROM documents))",
    "fragment_units": f"SELECT doc_id, CAST(f AS INTEGER) AS f, piece FROM (SELECT doc_id, unnest(l) AS piece, unnest(range(0, len(l))) AS f FROM (SELECT doc_id, {_fragments('text')} AS l FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))",
    "unit_hierarchy": _with(UNITS, "SELECT * FROM units"),
    "token_counts": rf"SELECT doc_id, CAST({_tokens('text')} AS INTEGER) AS token_count, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS word_count FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "greedy_chunks": _with(UNITS + _chunks("none"), "SELECT chunk_id, first_unit, unit_count, token_count FROM chunks"),
    "overlap_last_unit": _with(UNITS + _chunks("last_unit"), "SELECT chunk_id, first_unit, unit_count, overlap_tokens, token_count FROM chunks"),
    "overlap_last_sentence": _with(CHUNKS, "SELECT chunk_id, first_unit, unit_count, overlap_tokens, token_count FROM chunks"),
    "chunk_texts": _with(CHUNKS, "SELECT patent_id, section, chunk_id, text FROM chunks"),
    "chunk_indexes": _with(JUDGED, "SELECT patent_id, chunk_id, section_chunk_index, document_chunk_index, total_chunks FROM valid"),
    "chunk_sizes": _with(CHUNKS, "SELECT chunk_id, token_count, word_count FROM chunks"),
    "chunk_offsets": _with(CHUNKS, "SELECT chunk_id, start_offset, end_offset FROM chunks"),
    "ws_normalised": r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM documents",
    "heading_only": _with(PATENTS, rf"SELECT patent_id, line_no, {_heading('norm')} AS heading_only FROM (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS norm FROM lines) WHERE norm <> ''"),
    "alpha_ratio": r"SELECT doc_id, round(r, 6) AS alpha_ratio, round(r, 6) < 0.30 AS rejected FROM (SELECT doc_id, coalesce(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / CAST(nullif(length(text), 0) AS DOUBLE), 0) AS r FROM documents)",
    "overlap_novelty": _with(JUDGED, "SELECT chunk_id, round(novelty, 6) AS novelty, coalesce(novelty < 0.10, false) AS rejected FROM judged"),
    "novelty_in_section": _with(
        JUDGED,
        "SELECT chunk_id, round(novelty, 6) AS novelty, coalesce(novelty < 0.10, false) AS rejected FROM (SELECT chunk_id,"
        " CASE WHEN chunk_no > 0 THEN coalesce(fresh, 0) / CAST(nullif(len(toks), 0) AS DOUBLE) END AS novelty FROM jt LEFT JOIN"
        " (SELECT patent_id, section_idx, chunk_no, count(*) AS fresh FROM (SELECT patent_id, section_idx, min(chunk_no) AS chunk_no FROM"
        " (SELECT patent_id, section_idx, chunk_no, unnest(toks) AS tok FROM jt) GROUP BY patent_id, section_idx, tok) GROUP BY ALL)"
        " USING (patent_id, section_idx, chunk_no))",
    ),
    "min_tokens": _with(JUDGED, "SELECT chunk_id, token_count FROM judged WHERE token_count < 20"),
    "duplicate_chunks": _with(JUDGED, "SELECT chunk_id, patent_id FROM judged WHERE reject_reason = 'duplicate'"),
    "reject_reasons": _with(JUDGED, "SELECT chunk_id, reject_reason FROM judged"),
    "validation_report": _with(JUDGED, "SELECT coalesce(reject_reason, 'valid') AS outcome, section, count(*) AS chunks FROM judged GROUP BY ALL"),
    "hash_embeddings": _with(JUDGED + _embedded("valid", "chunk_id", "cv"), "SELECT chunk_id, bucket, round(weight, 6) AS weight FROM cv"),
    "unit_norms": "SELECT vec_id, round(n, 5) AS norm, CAST(len(embedding) AS INTEGER) AS dim, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unit_norm FROM (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)",
    "cosine_scores": _with(_VECTORS, "SELECT query_id, label, count(*) AS points, min(vector_score) AS least, round(avg(vector_score), 4) AS mean, max(vector_score) AS most FROM s GROUP BY ALL"),
    "vector_top_k": _with(_VECTORS, "SELECT query_id, id, vector_score, vector_rank FROM top"),
    "hits_with_payload": _with(_VECTORS, "SELECT query_id, id, label, vector_rank FROM top"),
    "label_results": _with(_VECTORS, "SELECT query_id, label, max(vector_score) AS score, arg_min(id, vector_rank) AS best_id, count(*) AS hits FROM top GROUP BY ALL"),
    "rerank_pairs": _with(HITS, "SELECT query_id, chunk_id, vector_score, vector_rank, CAST(length(query_text) AS INTEGER) AS query_chars, CAST(length(text) AS INTEGER) AS text_chars FROM pairs"),
    "rerank_scores": _with(HITS, "SELECT query_id, chunk_id, rerank_score FROM rs"),
    "rerank_top_k": _with(HITS, "SELECT query_id, chunk_id, rerank_score, rerank_rank FROM top"),
    "patent_scores": _with(HITS, "SELECT query_id, patent_id, score FROM results"),
    "best_chunk": _with(HITS, "SELECT query_id, patent_id, best_id AS chunk_id, best_score AS rerank_score FROM results"),
    "matching_chunks": _with(HITS, "SELECT query_id, patent_id, CAST(row_number() OVER (PARTITION BY query_id, patent_id ORDER BY rerank_rank) - 1 AS INTEGER) AS place, chunk_id, rerank_score FROM top"),
    "patent_results": _with(HITS, "SELECT query_id, patent_id, score, chunks, lang, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, patent_id) AS INTEGER) AS patent_rank FROM results JOIN patents USING (patent_id)"),
    "context_blocks": _with(HITS, "SELECT query_id, patent_id, score, block FROM results"),
    "prompts": _with(
        HITS,
        f"SELECT b.item_id AS query_id, '{INSTRUCTIONS}' || chr(10) || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || coalesce(b.text, '') || chr(10) || 'Answer:' AS prompt"
        " FROM benchmark b LEFT JOIN (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY score DESC, patent_id) AS context FROM results GROUP BY query_id) c ON c.query_id = b.item_id",
    ),
    "indexed_summary": _with(JUDGED, "SELECT patent_id, count(*) AS chunks, count(DISTINCT section) AS sections, CAST(sum(token_count) AS BIGINT) AS tokens, any_value(lang) AS lang, any_value(source) AS source FROM valid JOIN patents USING (patent_id) GROUP BY patent_id"),
    "section_breakdown": _with(JUDGED, "SELECT patent_id, section, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(token_count), 6) AS avg_tokens FROM valid GROUP BY ALL"),
    "collection_report": _with(
        JUDGED,
        "SELECT patent_id, section, CASE grouping(patent_id, section) WHEN 0 THEN 'section' WHEN 1 THEN 'patent' ELSE 'collection' END AS level,"
        " count(*) AS chunks, count(DISTINCT (patent_id, section)) AS sections, CAST(sum(token_count) AS BIGINT) AS tokens,"
        " min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(token_count), 6) AS avg_tokens"
        " FROM valid GROUP BY ROLLUP (patent_id, section)",
    ),
    "upsert_merge": _with(
        CHUNKS + _chunks("none", "n_"),
        "SELECT chunk_id, patent_id, n_chunks.token_count, 2 AS version FROM n_chunks JOIN patents USING (patent_id) WHERE lang = 'en' UNION ALL"
        " SELECT chunk_id, patent_id, token_count, 1 FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM n_chunks JOIN patents USING (patent_id) WHERE lang = 'en')",
    ),
    "document_metadata_join": "SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
}
ORACLES["collection_upsert"] = ORACLES["upsert_merge"]
ORACLES["inverted_file_all_lists"] = ORACLES["vector_top_k"]
