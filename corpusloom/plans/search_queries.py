"""Queries on text, chunks, vectors and search, each with its comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.vectors import dot, l2_normalize
from corpusloom.operators import bounded, chunking, dense, embedding, lexical, ranking, search, spaces
from corpusloom.plans import sqltext as S
from corpusloom.plans import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIMS, FLOOR = 32, 0.2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = V.spread(V.notes(spark, sf_dir)).transform(chunking.plan_chunks)
    return embedding.embed_chunks(planned, embedding.HashingEmbedder(DIMS)).drop("input")  # the text and the title again


#: The notes' chunks with hashing vectors, their postings and vocabulary: built once and read by every search.
chunk_index = V.kept("chunk_index", _chunk_index)
chunk_postings = V.kept("chunk_postings", lambda spark, sf_dir: lexical.postings_of_chunks(chunk_index(spark, sf_dir)))
indexed_notes = V.kept("indexed_notes", lambda spark, sf_dir: chunk_index(spark, sf_dir).agg(F.count_distinct("note_id").alias("n")))
chunk_vocab = V.kept("chunk_vocab", lambda spark, sf_dir: lexical.vocabulary(chunk_postings(spark, sf_dir), indexed_notes(spark, sf_dir)))


def built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"postings": chunk_postings(spark, sf_dir), "vocab": chunk_vocab(spark, sf_dir), "n_docs": indexed_notes(spark, sf_dir)}


def embedded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.note_queries(spark, sf_dir)
    vectors = embedding.embed_chunks(q, embedding.HashingEmbedder(DIMS), "q")
    return vectors.withColumnRenamed("embedding", "vector")


def named_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.notes(spark, sf_dir)
    ids = n.select("id", spaces.parse_space_ids(F.col("space_ids")).alias("space_ids"))
    return n.select("id", "title", "updated_at").join(spaces.resolve_spaces(ids, V.spaces(spark, sf_dir)), "id")


def n_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))


@query(S.with_(S.NOTES, body=f"SELECT doc_id, md5({S.fold('body')}) AS folded FROM notes"))
def fold_text(spark, sf_dir):
    return V.spread(V.notes(spark, sf_dir)).select("doc_id", F.md5(T.fold_text(F.col("body")).cast("binary")).alias("folded"))


@query(S.with_(S.NOTES, f"w AS (SELECT DISTINCT unnest({S.words('title')}) AS word FROM notes)", body=f"SELECT word, {S.stem('word')} AS stem FROM w"))
def fold_inflection(spark, sf_dir):
    words = V.notes(spark, sf_dir).select(F.explode(F.regexp_extract_all(T.fold_text(F.col("title")), F.lit(T.WORD), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.fold_inflection(F.col("word")).alias("stem"))


@query(S.with_(S.NOTES, f"t AS (SELECT unnest({S.tokens('body')}) AS term FROM notes)", body="SELECT term, count(*) AS n FROM t GROUP BY term"))
def tokenize(spark, sf_dir):
    return V.spread(V.notes(spark, sf_dir)).select(F.explode(T.tokenize(F.col("body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(S.with_(S.NOTES, body=f"SELECT doc_id, {S.slug('title')} AS slug FROM notes"))
def slugify(spark, sf_dir):
    return V.notes(spark, sf_dir).select("doc_id", T.slugify(F.col("title")).alias("slug"))


@query(S.with_(S.NOTES, body=f"SELECT doc_id, {S.fingerprint('title', 'body')} AS fingerprint FROM notes"))
def content_fingerprint(spark, sf_dir):
    return V.notes(spark, sf_dir).select("doc_id", T.content_fingerprint(F.col("title"), F.col("body")).alias("fingerprint"))


@query(S.with_(S.NOTES, body=f"SELECT doc_id, {S.path('title', 'id', 'created_at')} AS path FROM notes"))
def note_path(spark, sf_dir):
    return V.notes(spark, sf_dir).select("doc_id", T.note_path(F.col("title"), F.col("id"), F.col("created_at")).alias("path"))


_MS = "1700000000000 + doc_id * 86400123"


@query(f"SELECT doc_id, {S.base32(_MS)} AS head, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN {_MS} END AS ms FROM documents")
def ulid_time(spark, sf_dir):
    ms = F.lit(1700000000000) + F.col("doc_id") * 86400123
    head = T.ulid_encode_time(ms)
    given = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("I"), F.substring(head, 2, 9), F.lit("ABCDEFGHJKMNPQRS"))).when(F.col("doc_id") % 11 == 0, F.left(head, F.lit(9))).otherwise(F.concat(head, F.lit("ABCDEFGHJKMNPQRS")))
    return V.read(spark, sf_dir, "documents").select("doc_id", head.alias("head"), T.ulid_time(given).alias("ms"))


@query(
    S.with_(
        S.NOTES,
        "a AS (SELECT doc_id, updated_at, greatest(0, date_diff('second', updated_at, TIMESTAMP '2024-01-25')) AS s FROM notes)",
        body="SELECT doc_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE strftime(updated_at, '%Y-%m-%d') END AS bucket FROM a",
    )
)
def recency_bucket(spark, sf_dir):
    return V.notes(spark, sf_dir).select("doc_id", T.recency_bucket(F.col("updated_at"), F.lit("2024-01-25 00:00:00").cast("timestamp")).alias("bucket"))


@query(S.with_(S.NOTES, S.CHUNKS, body='SELECT note_id, idx, "offset", length(text) AS length, md5(text) AS text FROM body_chunks'))
def chunk_text(spark, sf_dir):
    n = V.spread(V.notes(spark, sf_dir)).withColumnRenamed("id", "note_id")
    return chunking.chunk_text(n, "body", ["note_id"]).select("note_id", F.col("idx").cast("long").alias("idx"), F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), F.md5(F.col("text").cast("binary")).alias("text"))


@query(S.with_(S.NOTES, S.CHUNKS, body='SELECT note_id, idx, kind, "offset", length, md5(input) AS input FROM chunks'))
def plan_chunks(spark, sf_dir):
    planned = chunking.plan_chunks(V.spread(V.notes(spark, sf_dir)))
    return planned.select("note_id", F.col("idx").cast("long").alias("idx"), "kind", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), F.md5(F.col("input").cast("binary")).alias("input"))


@query(S.with_(S.NOTES, S.CHUNKS, S.CHUNK_VECTORS, body="SELECT note_id, idx, bucket, round(v, 6) AS v FROM cv WHERE round(v, 6) <> 0"))
def hash_embed(spark, sf_dir):
    planned = chunking.plan_chunks(V.spread(V.notes(spark, sf_dir)))
    vectors = embedding.hash_embedded(planned, DIMS, ["note_id", "idx"])
    return vectors.select("note_id", F.col("idx").cast("long").alias("idx"), F.posexplode("embedding").alias("bucket", "v")).select("note_id", "idx", F.col("bucket").cast("long").alias("bucket"), F.round("v", 6).alias("v")).filter("v <> 0")


@query(f"WITH n AS (SELECT vec_id, embedding, sqrt({S.product('embedding', 'embedding')}) AS norm FROM embeddings) SELECT vec_id, round(embedding[1]::DOUBLE / norm, 6) AS first, round(embedding[64]::DOUBLE / norm, 6) AS last, len(embedding) AS dims FROM n")
def l2_normalize_(spark, sf_dir):
    v = V.read(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.element_at("v", 64), 6).alias("last"), F.size("v").cast("long").alias("dims"))


QUERIES["l2_normalize"], SQL["l2_normalize"] = QUERIES.pop("l2_normalize_"), SQL.pop("l2_normalize_")


@query(
    S.with_(
        S.VEC,
        f"d AS (SELECT qid, vec_id, round({S.product('vector', 'embedding')}, 9) AS score FROM vec_queries, vec_chunks)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM d)",
        body="SELECT qid, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
    )
)
def dot_topk(spark, sf_dir):
    index = V.vec_chunks(spark, sf_dir).select(F.col("vec_id").alias("note_id"), F.lit(0).alias("idx"), "embedding")
    best = dense.best_chunk(index, V.vec_queries(spark, sf_dir), k=5)
    return dense.top_k(best, 5).select("qid", F.col("note_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def embed_chunks(spark, sf_dir):
    return chunk_index(spark, sf_dir).select("note_id", "idx", F.size("embedding").alias("dims"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


#: Sorted, so that equal terms lie together: fewer bytes are written and sent.
note_postings = V.kept("note_postings", lambda spark, sf_dir: lexical.build_postings(V.spread(V.notes(spark, sf_dir))).sortWithinPartitions("term", "tf", "note_id"))
note_vocab = V.kept("note_vocab", lambda spark, sf_dir: lexical.vocabulary(note_postings(spark, sf_dir), n_notes(spark, sf_dir)))


@query(S.with_(S.NOTES, S.NOTE_POSTINGS, body="SELECT * FROM postings"))
def lexical_postings(spark, sf_dir):
    return lexical.build_postings(V.spread(V.notes(spark, sf_dir)))


@query(S.with_(S.NOTES, S.CHUNKS, S.CHUNK_POSTINGS, body="SELECT note_id, count(*) AS n_terms, sum(tf)::BIGINT AS tf, count_if(in_title) AS n_title FROM postings GROUP BY note_id"))
def lexical_docs(spark, sf_dir):
    planned = chunking.plan_chunks(V.spread(V.notes(spark, sf_dir)))
    return lexical.postings_of_chunks(planned).groupBy("note_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("tf"), F.count_if("in_title").alias("n_title"))


@query(S.with_(S.NOTES, S.NOTE_POSTINGS, S.VOCAB, body="SELECT term, df, round(idf, 6) AS idf FROM vocab"))
def lexical_vocab(spark, sf_dir):
    return lexical.vocabulary(note_postings(spark, sf_dir), n_notes(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(S.with_(S.NOTES, S.QUERIES, S.NOTE_POSTINGS, S.VOCAB, S.EXPANDED, body="SELECT qid, qterm, term, weight FROM expanded"))
def prefix_expand(spark, sf_dir):
    return lexical.expand_terms(lexical.query_terms(V.note_queries(spark, sf_dir)), note_vocab(spark, sf_dir)).select("qid", "qterm", "term", "weight")


@query(S.with_(S.NOTES, S.QUERIES, S.NOTE_POSTINGS, S.VOCAB, S.EXPANDED, S.LEXICAL, body="SELECT qid, note_id, round(score, 6) AS score, in_title, rank FROM lexical WHERE rank <= 32"))
def lexical_search(spark, sf_dir):
    found = lexical.lexical_search(note_postings(spark, sf_dir), V.note_queries(spark, sf_dir), n_notes(spark, sf_dir), 32, vocab=note_vocab(spark, sf_dir))
    return found.select("qid", "note_id", F.round("score", 6).alias("score"), "in_title", F.col("rank").cast("long").alias("rank"))


def _blocks(spark, sf_dir):
    return bounded.posting_blocks(note_postings(spark, sf_dir), store=V.stored)


note_blocks = V.once("note_blocks", _blocks)


@query(SQL["lexical_search"])
def lexical_bounded(spark, sf_dir):
    """The same rows from the blocks of postings that can matter."""
    found = bounded.bounded_search(*note_blocks(spark, sf_dir), V.note_queries(spark, sf_dir), n_notes(spark, sf_dir), 32, note_vocab(spark, sf_dir), V.stored)[0]
    return found.select("qid", "note_id", F.round("score", 6).alias("score"), "in_title", F.col("rank").cast("long").alias("rank"))


@query()
def lexical_read_share(spark, sf_dir):
    """How many of the postings of a query's terms are read for its first ten notes."""
    return bounded.bounded_search(*note_blocks(spark, sf_dir), V.note_queries(spark, sf_dir), n_notes(spark, sf_dir), 10, note_vocab(spark, sf_dir), V.stored)[1]


_DELTA = S.NOTES.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 1)").replace("text AS body", "CASE WHEN doc_id % 10 = 0 THEN 'changed ' || lang ELSE text END AS body")


@query(S.with_(_DELTA, S.NOTE_POSTINGS, body="SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM postings GROUP BY term"))
def lexical_delta(spark, sf_dir):
    n = V.spread(V.notes(spark, sf_dir))
    lang = V.read(spark, sf_dir, "documents").select("doc_id", "lang")
    changed = n.filter("doc_id % 10 = 0").join(lang, "doc_id").withColumn("body", F.concat(F.lit("changed "), "lang")).select("id", "title", "body")
    after = lexical.apply_postings_delta(lexical.build_postings(n), changed, n.filter("doc_id % 10 = 1").select("id"))
    return after.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(S.with_(_DELTA, S.NOTE_POSTINGS, S.VOCAB, body="SELECT term, df, round(idf, 6) AS idf FROM vocab"))
def lexical_upkeep(spark, sf_dir):
    """The vocabulary after the same changes, from the numbers that were kept up."""
    n = V.spread(V.notes(spark, sf_dir))
    lang = V.read(spark, sf_dir, "documents").select("doc_id", "lang")
    changed = V.stored(n.filter("doc_id % 10 = 0").join(lang, "doc_id").withColumn("body", F.concat(F.lit("changed "), "lang")).select("id", "title", "body"))
    deleted = n.filter("doc_id % 10 = 1").select("id")
    docs = n.filter("doc_id % 10 > 1").select("id", "title", "body").union(changed)
    held = note_vocab(spark, sf_dir).select("term", "df")
    _, df, n_docs = lexical.maintain(note_postings(spark, sf_dir), held, n.count(), docs, changed, deleted)
    return df.select("term", "df", F.round(lexical.idf(F.lit(n_docs), F.col("df")), 6).alias("idf"))


@query(S.with_(S.VEC, body="SELECT note_id, count(*) AS n_chunks FROM vec_chunks WHERE vec_id % 7 <> 0 AND len(embedding) = 64 GROUP BY note_id"))
def dense_same_model(spark, sf_dir):
    index = V.vec_chunks(spark, sf_dir).withColumns({"model_id": F.when(F.col("vec_id") % 7 == 0, "old").otherwise("new"), "dimensions": F.size("embedding")})
    return dense.same_model(index, "new", 64).groupBy("note_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def vec_best(spark, sf_dir, min_score, k=None):
    return dense.best_chunk(V.vec_chunks(spark, sf_dir), V.vec_queries(spark, sf_dir), min_score, k)


@query(S.with_(S.VEC, S.VEC_BEST, body="SELECT qid, note_id, idx, round(score, 6) AS score FROM vec_best WHERE score >= 0.1"))
def dense_best_chunk(spark, sf_dir):
    return vec_best(spark, sf_dir, 0.1).withColumn("score", F.round("score", 6))


@query(S.with_(S.VEC, S.VEC_BEST, body="SELECT qid, note_id, idx, round(score, 6) AS score FROM vec_best"))
def dense_all_notes(spark, sf_dir):
    """The best chunk of every note for every query, without a floor."""
    return vec_best(spark, sf_dir, None).withColumn("score", F.round("score", 6))


@query(S.with_(S.VEC, S.VEC_BEST, "r AS (SELECT qid, note_id, idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, note_id) AS rank FROM vec_best WHERE score >= 0.1)", body="SELECT qid, note_id, idx, round(score, 6) AS score, rank FROM r WHERE rank <= 20"))
def dense_search(spark, sf_dir):
    found = dense.dense_search(vec_best(spark, sf_dir, 0.1, 20), 0.1, 20)
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(S.with_(S.VEC, S.VEC_BEST, "o AS (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM vec_best WHERE score >= 0.1 AND note_id <> own)", body="SELECT qid, note_id, round(score, 6) AS score FROM o WHERE top <= 0.1 OR score >= 0.1 + 0.6 * (top - 0.1)"))
def relative_cutoff(spark, sf_dir):
    own = V.vec_queries(spark, sf_dir).select("qid", "own")
    others = V.stored(vec_best(spark, sf_dir, 0.1).join(own, "qid").filter("note_id <> own"))
    return dense.relative_cutoff(others, 0.6, 0.1).select("qid", "note_id", F.round("score", 6).alias("score"))


def _fused_sql(floor: str = "", depth: str = "") -> str:
    return S.with_(
        S.VEC,
        S.VEC_BEST,
        f"a AS (SELECT * FROM (SELECT qid, note_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, note_id) AS rank FROM vec_best WHERE true{floor}){depth})",
        f"b AS (SELECT * FROM (SELECT qid, note_id, row_number() OVER (PARTITION BY qid ORDER BY note_id * 7919 % 1009, note_id) AS rank FROM vec_best WHERE note_id % 2 = 0{floor}){depth})",
        "f AS (SELECT qid, note_id, a.rank AS r0, b.rank AS r1, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 12) AS s FROM a FULL OUTER JOIN b USING (qid, note_id))",
        "g AS (SELECT *, s / max(s) OVER (PARTITION BY qid) AS score FROM f)",
        body="SELECT qid, note_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST, note_id) AS rank FROM g",
    )


def _fused(spark, sf_dir, floor: float | None, depth: int):
    best = V.stored(vec_best(spark, sf_dir, floor))
    other = best.filter("note_id % 2 = 0").select("qid", "note_id", (-(F.col("note_id") * 7919 % 1009)).alias("score"))
    lists = [dense.top_k(b, depth).select("qid", "note_id", "rank") for b in (best, other)]
    return ranking.fuse_rankings(lists).select("qid", "note_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_fused_sql(" AND score >= 0.1", " WHERE rank <= 100"))
def rrf_fuse(spark, sf_dir):
    """The first hundred of two rankings of each query, fused."""
    return _fused(spark, sf_dir, 0.1, 100)


@query(_fused_sql())
def rrf_fuse_whole(spark, sf_dir):
    """Two whole rankings of each query, fused."""
    return _fused(spark, sf_dir, None, (1 << 31) - 1)


_HYBRID = (S.NOTES, S.QUERIES, S.CHUNKS, S.CHUNK_VECTORS, S.QUERY_VECTORS, S.CHUNK_POSTINGS, S.VOCAB, S.EXPANDED, S.LEXICAL, S.DENSE, S.HYBRID)


@query(S.with_(*_HYBRID, body="SELECT qid, note_id, rank, round(score, 6) AS score, CASE WHEN is_lexical THEN 'text' ELSE 'semantic' END AS match_kind FROM placed WHERE rank <= 10"))
def hybrid_search(spark, sf_dir):
    hits = search.hybrid_search(chunk_index(spark, sf_dir), embedded_queries(spark, sf_dir), store=V.stored, top_k_notes=10, min_score=FLOOR, cutoff=0.6, **built(spark, sf_dir))
    return hits.select("qid", "note_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "match_kind")


@query(
    S.with_(
        *_HYBRID,
        "hits AS (SELECT p.qid, p.note_id, p.rank, p.is_lexical, b.best_idx FROM placed p JOIN best b USING (qid, note_id) WHERE p.rank <= 10)",
        f"qt AS (SELECT qid, {S.tokens('q')} AS ts FROM queries)",
        f"opts AS (SELECT h.qid, h.note_id, h.rank, c.idx, c.text, CASE WHEN h.is_lexical AND len(list_filter(ts, lambda t: contains({S.fold('c.text')}, t))) > 0 THEN 0 WHEN c.idx = h.best_idx THEN 1 END AS o FROM hits h JOIN chunks c USING (note_id) JOIN qt USING (qid))",
        body="SELECT qid, note_id, rank, arg_min(idx, {'o': o, 'i': idx}) AS chunk_idx, md5(arg_min(text, {'o': o, 'i': idx})) AS snippet FROM opts WHERE o IS NOT NULL GROUP BY qid, note_id, rank",
    )
)
def snippets(spark, sf_dir):
    index, queries = chunk_index(spark, sf_dir), embedded_queries(spark, sf_dir)
    hits = search.hybrid_search(index, queries, store=V.stored, top_k_notes=10, min_score=FLOOR, cutoff=0.6, **built(spark, sf_dir)).select("qid", "note_id", "rank", "best_idx", "is_lexical")
    out = search.pick_snippet(hits, index, queries.select("qid", "q"))
    return out.select("qid", "note_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_idx").cast("long").alias("chunk_idx"), F.md5(F.col("snippet").cast("binary")).alias("snippet"))


_BONUS = (S.NOTES, S.SPACES, S.QUERIES, S.SPACE_NAMES, S.BONUS)


@query(S.with_(*_BONUS, body="SELECT qid, note_id, title_bonus AS bonus FROM bonuses WHERE title_bonus > 0"))
def title_bonus(spark, sf_dir):
    found = ranking.note_bonuses(V.note_queries(spark, sf_dir), named_notes(spark, sf_dir))
    return found.filter("title_bonus > 0").select("qid", "note_id", F.col("title_bonus").alias("bonus"))


@query(S.with_(*_BONUS, body="SELECT qid, note_id, space_bonus AS bonus, whole FROM bonuses WHERE space_bonus > 0"))
def space_signal(spark, sf_dir):
    found = ranking.note_bonuses(V.note_queries(spark, sf_dir), named_notes(spark, sf_dir))
    return found.filter("space_bonus > 0").select("qid", "note_id", F.col("space_bonus").alias("bonus"), "whole")


@query(S.with_(*_BONUS, S.NOTE_POSTINGS, S.VOCAB, S.EXPANDED, S.LEXICAL, "content AS (SELECT qid, note_id, rank AS pos, score, 'text' AS match_kind FROM lexical WHERE rank <= 8)", S.ranked_notes("content", 20), body="SELECT qid, note_id, round(score, 6) AS score, match_kind, rank FROM top"))
def rank_notes(spark, sf_dir):
    queries = V.note_queries(spark, sf_dir)
    content = lexical.lexical_search(note_postings(spark, sf_dir), queries, n_notes(spark, sf_dir), 8, vocab=note_vocab(spark, sf_dir))
    content = content.select("qid", "note_id", F.col("rank").alias("pos"), "score", F.lit("text").alias("match_kind"))
    notes = named_notes(spark, sf_dir)
    out = ranking.rank_notes(ranking.note_bonuses(queries, notes), content, ranking.recency_positions(notes), 20)
    return out.select("qid", "note_id", F.round("score", 6).alias("score"), "match_kind", F.col("rank").cast("long").alias("rank"))


@query(
    S.with_(
        *_HYBRID,
        S.SPACES,
        S.SPACE_NAMES,
        S.BONUS,
        "content AS (SELECT qid, note_id, rank AS pos, round(score, 9) AS score, CASE WHEN is_lexical THEN 'text' ELSE 'semantic' END AS match_kind FROM placed WHERE rank <= 8)",
        S.ranked_notes("content", 20),
        body="SELECT qid, note_id, round(score, 6) AS score, match_kind, rank FROM top",
    )
)
def search_notes(spark, sf_dir):
    out = search.search_notes(chunk_index(spark, sf_dir), named_notes(spark, sf_dir), embedded_queries(spark, sf_dir), store=V.stored, min_score=FLOOR, limit=20, **built(spark, sf_dir))
    return out.select("qid", "note_id", F.round("score", 6).alias("score"), "match_kind", F.col("rank").cast("long").alias("rank"))


@query(S.with_(S.NOTES, body=f"SELECT id, title, {S.text_time('updated_at')} AS updated_at, 'recent' AS match_kind FROM notes ORDER BY notes.updated_at DESC, id LIMIT 8"))
def recent_notes(spark, sf_dir):
    return ranking.recent_notes(V.notes(spark, sf_dir)).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))
