"""Pieces of the comparison SQL: the views and the shared steps as common table expressions for DuckDB."""

from __future__ import annotations

from corpusloom.functions.text import BASE32
from corpusloom.plans.views import EDGE_QUERIES, LANGUAGES


def with_(*ctes: str, body: str) -> str:
    """A query over the named expressions, each once."""
    return "WITH " + ",\n".join(dict.fromkeys(c.strip() for c in ctes)) + "\n" + body.strip()


def fold(x: str) -> str:
    return f"lower(regexp_replace(strip_accents({x}), '[\\^`¨¯´·¸]', '', 'g'))"


def stem(t: str) -> str:
    s = f"(CASE WHEN {t} LIKE '%es' AND length({t}) >= 6 THEN left({t}, length({t}) - 2) WHEN {t} LIKE '%s' AND length({t}) >= 5 THEN left({t}, length({t}) - 1) ELSE {t} END)"
    return f"(CASE WHEN right({s}, 1) IN ('a', 'o', 'e') AND length({s}) >= 5 THEN left({s}, length({s}) - 1) ELSE {s} END)"


def words(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[\\p{{L}}\\p{{N}}]+')"


def tokens(x: str) -> str:
    return f"list_transform({words(x)}, lambda t: {stem('t')})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '\\s+', ' ', 'g'))"


def slug(x: str) -> str:
    s = f"left(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"
    return f"(CASE WHEN {s} = '' THEN 'untitled' ELSE {s} END)"


def path(title: str, note_id: str, created: str) -> str:
    return f"'notes/' || strftime({created}, '%Y/%m') || '/' || {slug(title)} || '-' || {note_id} || '.md'"


def canonical(x: str) -> str:
    return f"regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '\\s+$', ''), '^\\n+', '')"


def fingerprint(title: str, body: str) -> str:
    return f"sha256({title} || chr(10) || chr(10) || {canonical(body)})"


def base32(ms: str) -> str:
    return " || ".join(f"substr('{BASE32}', ((({ms}) >> {5 * k}) & 31)::INT + 1, 1)" for k in range(9, -1, -1))


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.000Z')"


def text_time(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def product(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


NOTES = """
notes AS (
  SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, doc_id,
         array_to_string(list_slice(regexp_extract_all(text, '\\S+'), 1, 8), ' ') AS title, text AS body,
         TIMESTAMP '2024-01-01' + to_days((doc_id % 366)::INT) AS created_at,
         TIMESTAMP '2024-01-01' + to_seconds(doc_id * 7919 % 2592000) AS updated_at,
         CASE WHEN doc_id % 5 <> 0 THEN lang || ',' || source END AS space_ids, lang, source
  FROM documents)
"""

_names = " ".join(f"WHEN lang = '{k}' THEN '{v}'" for k, v in LANGUAGES.items())
SPACES = f"""
spaces AS (
  SELECT DISTINCT lang AS id, CASE {_names} ELSE lang END AS name FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT DISTINCT source AS id, 'Source ' || substr(source, 4) AS name FROM documents WHERE source IS NOT NULL)
"""

_edge = ", ".join(f"({i}, '{q}')" for i, q in EDGE_QUERIES)
QUERIES = f"""
queries AS (
  SELECT item_id AS qid, array_to_string(list_slice(regexp_extract_all(text, '\\S+'), 1, 2), ' ') AS q FROM benchmark
  UNION ALL SELECT * FROM (VALUES {_edge}) AS e(qid, q))
"""

CHUNKS = """
pieces AS (
  SELECT id AS note_id, title, length(body) - length(regexp_replace(body, '^\\s+', '')) AS lead,
         regexp_extract_all(body, '(?:\\S+\\s*){1,24}') AS p FROM notes),
windows AS (SELECT note_id, title, lead, p, unnest(range(0, 1 + greatest(0, ceil((len(p) - 5) / 4.0))::BIGINT)) AS k FROM pieces WHERE len(p) > 0),
body_chunks AS (
  SELECT note_id, title, k AS idx, regexp_replace(array_to_string(list_slice(p, 4 * k + 1, 4 * k + 5), ''), '\\s+$', '') AS text,
         lead + coalesce(list_sum(list_transform(list_slice(p, 1, 4 * k), lambda x: length(x))), 0)::BIGINT AS "offset" FROM windows),
chunks AS (
  SELECT id AS note_id, -1 AS idx, 'title' AS kind, trim(title) AS text, 0 AS "offset", 0 AS length, trim(title) AS input FROM notes WHERE trim(title) <> ''
  UNION ALL
  SELECT note_id, idx, 'body', text, "offset", length(text), CASE WHEN trim(title) <> '' THEN trim(title) || chr(10) || chr(10) || text ELSE text END FROM body_chunks)
"""


def embedded(source: str, keys: str, text: str, out: str, dims: int = 32) -> str:
    """Long hashing vectors (keys, bucket, v) of a table's text."""
    return f"""
{out}_words AS (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}),
{out}_hashed AS (
  SELECT w, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(w, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296) AS h
  FROM (SELECT DISTINCT w FROM {out}_words)),
{out}_sums AS (SELECT {keys}, h % {dims} AS bucket, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {out}_words JOIN {out}_hashed USING (w) GROUP BY ALL),
{out}_norms AS (SELECT {keys}, sqrt(sum(v * v)) AS norm FROM {out}_sums GROUP BY ALL),
{out} AS (SELECT {keys}, bucket, CASE WHEN norm = 0 THEN v ELSE v / norm END AS v FROM {out}_sums JOIN {out}_norms USING ({keys}))
"""


CHUNK_VECTORS = embedded("chunks", "note_id, idx", "input", "cv")
QUERY_VECTORS = embedded("(SELECT * FROM queries WHERE trim(q) <> '')", "qid", "q", "qv")

NOTE_POSTINGS = f"""
fields AS (
  SELECT id AS note_id, unnest({tokens('title')}) AS term, 3 AS w, true AS t FROM notes
  UNION ALL SELECT id, unnest({tokens('body')}), 1, false FROM notes),
postings AS (SELECT term, note_id, sum(w)::BIGINT AS tf, bool_or(t) AS in_title FROM fields GROUP BY ALL),
n_docs AS (SELECT count(*) AS n FROM notes)
"""
CHUNK_POSTINGS = f"""
chunk_terms AS (SELECT note_id, kind = 'title' AS t, unnest({tokens('text')}) AS term FROM chunks),
postings AS (SELECT term, note_id, sum(CASE WHEN t THEN 3 ELSE 1 END)::BIGINT AS tf, bool_or(t) AS in_title FROM chunk_terms GROUP BY ALL),
n_docs AS (SELECT count(DISTINCT note_id) AS n FROM chunks)
"""
VOCAB = "vocab AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, n_docs GROUP BY term)"
EXPANDED = f"""
terms AS (SELECT qid, unnest(list_distinct({tokens('q')})) AS qterm FROM queries),
expanded AS (
  SELECT qid, qterm, term, idf, 1.0::DOUBLE AS weight FROM terms JOIN vocab ON qterm = term
  UNION ALL
  SELECT qid, qterm, term, idf, 0.5::DOUBLE FROM terms JOIN vocab ON left(qterm, 3) = left(term, 3) AND starts_with(term, qterm) AND term <> qterm WHERE length(qterm) >= 3)
"""
LEXICAL = """
parts AS (SELECT qid, qterm, note_id, sum(idf * weight * tf / (tf + 1.2)) AS part, bool_or(in_title) AS in_title FROM expanded JOIN postings USING (term) GROUP BY ALL),
masses AS (SELECT qid, qterm, max(idf) AS mass FROM expanded GROUP BY ALL),
wholes AS (SELECT qid, sum(coalesce(mass, ln(1 + (n - 1 + 0.5) / 1.5))) AS whole FROM terms LEFT JOIN masses USING (qid, qterm), n_docs GROUP BY qid),
found AS (SELECT qid, note_id, sum(part) AS s, sum(mass) AS got, bool_or(in_title) AS in_title FROM parts JOIN masses USING (qid, qterm) GROUP BY ALL),
lexical AS (
  SELECT qid, note_id, round(s * got / whole, 9) AS score, in_title, row_number() OVER (PARTITION BY qid ORDER BY round(s * got / whole, 9) DESC, note_id) AS rank
  FROM found JOIN wholes USING (qid))
"""
SPACE_NAMES = """
note_space AS (SELECT id, unnest(string_split(space_ids, ',')) AS space_id, generate_subscripts(string_split(space_ids, ','), 1) AS pos FROM notes WHERE space_ids IS NOT NULL),
resolved AS (
  SELECT n.id, coalesce((SELECT list(coalesce(s.name, x.space_id) ORDER BY x.pos) FROM note_space x LEFT JOIN spaces s ON s.id = x.space_id WHERE x.id = n.id), ['General']) AS space_names
  FROM notes n)
"""
BONUS = f"""
titles AS (SELECT id AS note_id, {collapse('title')} AS tc, {tokens('title')} AS tt FROM notes),
asked AS (SELECT qid, {collapse('q')} AS qc, list_distinct({tokens('q')}) AS qt FROM queries WHERE trim(q) <> ''),
named AS (SELECT id AS note_id, flatten(list_transform(space_names, lambda s: {tokens('s')})) AS st FROM resolved),
bonuses_all AS (
  SELECT qid, note_id,
         CASE WHEN qc = '' OR tc = '' THEN 0.0 WHEN qc = tc THEN 1.2 WHEN starts_with(tc, qc) THEN 0.8 WHEN contains(tc, qc) THEN 0.5
              WHEN len(qt) > 0 AND len(list_intersect(qt, tt)) = len(qt) THEN 0.35 ELSE 0.0 END::DOUBLE AS title_bonus,
         CASE WHEN len(list_intersect(qt, st)) = 0 THEN 0.0 WHEN len(list_intersect(qt, st)) = len(qt) THEN 0.2 ELSE 0.1 END::DOUBLE AS space_bonus,
         len(qt) > 0 AND len(list_intersect(qt, st)) = len(qt) AS whole
  FROM titles JOIN named USING (note_id), asked),
bonuses AS (SELECT * FROM bonuses_all WHERE title_bonus > 0 OR space_bonus > 0)
"""


def ranked_notes(content: str, limit: int) -> str:
    """The merged ranking over bonuses and a content table (qid, note_id, pos, score, match_kind)."""
    return f"""
merged AS (
  SELECT coalesce(c.qid, b.qid) AS qid, coalesce(c.note_id, b.note_id) AS note_id, c.pos,
         round(coalesce(c.score, 0) + coalesce(title_bonus, 0) + coalesce(space_bonus, 0), 9) AS score,
         CASE WHEN title_bonus > 0 THEN 'title' WHEN space_bonus > 0 THEN 'space' ELSE c.match_kind END AS match_kind
  FROM {content} c FULL OUTER JOIN bonuses b ON c.qid = b.qid AND c.note_id = b.note_id
  WHERE c.pos IS NOT NULL OR title_bonus > 0 OR whole),
final AS (
  SELECT qid, note_id, m.score, match_kind, row_number() OVER (PARTITION BY qid ORDER BY m.score DESC, pos NULLS LAST, updated_at DESC, note_id) AS rank
  FROM merged m JOIN notes n ON n.id = m.note_id),
top AS (SELECT * FROM final WHERE rank <= {limit})
"""


DENSE = """
dots AS (
  SELECT qid, note_id, idx, sum(q.v * c.v) AS score FROM qv q JOIN cv c USING (bucket) GROUP BY ALL),
every AS (SELECT qid, note_id, idx, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT qid FROM qv) CROSS JOIN (SELECT note_id, idx FROM chunks) LEFT JOIN dots USING (qid, note_id, idx)),
best AS (SELECT qid, note_id, arg_min(idx, {'s': -round(score, 9), 'i': idx}) AS best_idx, max(round(score, 9)) AS score FROM every GROUP BY qid, note_id),
dense AS (SELECT qid, note_id, best_idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, note_id) AS rank FROM best WHERE score >= 0.2)
"""
HYBRID = """
lex AS (SELECT qid, note_id, rank FROM lexical WHERE rank <= 32),
fused AS (
  SELECT qid, note_id, l.rank AS r0, d.rank AS r1, round(coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + d.rank), 0), 12) AS s
  FROM lex l FULL OUTER JOIN dense d USING (qid, note_id)),
scored AS (SELECT qid, note_id, r0, r1, s / max(s) OVER (PARTITION BY qid) AS score FROM fused),
near AS (SELECT qid, note_id FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM dense) WHERE top <= 0.2 OR score >= 0.2 + 0.6 * (top - 0.2)),
shown AS (SELECT s.*, r0 IS NOT NULL AS is_lexical FROM scored s LEFT JOIN near n ON s.qid = n.qid AND s.note_id = n.note_id WHERE r0 IS NOT NULL OR n.qid IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST, note_id) AS rank FROM shown)
"""
VEC = """
vec_chunks AS (SELECT vec_id // 5 AS note_id, (vec_id % 5 - 1)::INT AS idx, embedding, vec_id FROM embeddings),
vec_queries AS (SELECT vec_id AS qid, vec_id // 5 AS own, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0)
"""
VEC_BEST = f"""
vec_dots AS (SELECT qid, own, note_id, idx, round({product('vector', 'embedding')}, 9) AS score FROM vec_queries, vec_chunks),
vec_best AS (SELECT qid, own, note_id, arg_min(idx, {{'s': -score, 'i': idx}}) AS idx, max(score) AS score FROM vec_dots GROUP BY ALL)
"""
VEC_BEST = VEC_BEST.replace("GROUP BY ALL)", "GROUP BY qid, own, note_id)")
