"""Queries on texts and vectors: cleaning, identities, chunks, duplicates and exact search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identity, text, vectors
from tidemark.operators.audit import canonical, retrievable
from tidemark.operators.chunker import chunk
from tidemark.operators.embed import embed_by_hash
from tidemark.operators.knn import exact_top_k, with_empty
from tidemark.operators.ledger import hash_ranked
from tidemark.session import computed_once, table, texts

K = 10
#: Numbers of a stored vector.
DIM = 64
EVERY = 20
NEAR = 0.35
SAMPLE = 200
#: Write numbers are odd, so their halves stand for them.
TWENTIETH = f"(id div 2) % {EVERY} = 0"


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their titles and cleaned bodies; the title is only made if asked for."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", "path")
    path = F.coalesce("path", F.concat(F.lit("page-"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", text.title_of(text.universal_newlines(F.col("text")), F.concat(path, F.lit(".md"))).alias("title"), text.clean_body(F.col("text")).alias("body"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body), each page cleaned once, whatever is then asked of the body."""
    return computed_once(texts(spark, sf_dir, "documents").select("doc_id", "text"), body=text.clean_body(F.col("text"))).drop("text")


def clean_documents(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return c.select(
        "doc_id", "title", identity.sha256_hex(F.col("body")).alias("content_sha256"), F.length("body").alias("n_chars"), text.word_count(F.col("body")).alias("n_words"), text.is_stub(F.col("body")).alias("is_stub")
    )


def stub_filter(spark, sf_dir):
    return cleaned(spark, sf_dir).where(~text.is_stub(F.col("body"))).select("doc_id")


def dup_clusters(spark, sf_dir):
    """Texts that several cleaned pages share, with the number of pages and the first of them."""
    hashed = cleaned(spark, sf_dir).select("doc_id", identity.sha256_hex(F.col("body")).alias("content_sha256"))
    return hashed.groupBy("content_sha256").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


def exact_dup_excess(spark, sf_dir):
    """Pages beyond the first of their text, and texts with several pages."""
    return dup_clusters(spark, sf_dir).agg(F.coalesce(F.sum(F.col("n_docs") - 1), F.lit(0)).alias("excess"), F.count("*").alias("clusters"))


def canonical_documents(spark, sf_dir):
    hashed = cleaned(spark, sf_dir).select("doc_id", identity.sha256_hex(F.col("body")).alias("content_sha256"))
    return canonical(hashed, "content_sha256", "doc_id")


def front_matter_split(spark, sf_dir):
    t = text.universal_newlines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.front_matter(t)).alias("front_chars"), F.length(text.without_front_matter(t)).alias("body_chars"))


def front_matter_values(spark, sf_dir):
    """How often each plain field of the pages' front matter is given, and how many different values it has."""
    docs = texts(spark, sf_dir, "documents").select(F.explode(text.front_matter_fields(text.universal_newlines(F.col("text")))).alias("f"))
    return docs.groupBy(F.col("f.key").alias("key")).agg(F.count("*").alias("n"), F.countDistinct("f.value").alias("n_values"), F.max("f.value").alias("greatest"))


def html_strip_pages(spark, sf_dir):
    stripped = text.without_markup(F.col("text"))
    return table(spark, sf_dir, "documents").where(stripped != F.col("text")).select("doc_id", F.sha2(stripped, 256).alias("stripped_sha256"))


def hash_bucket(spark, sf_dir):
    ids = table(spark, sf_dir, "doc_versions").select("doc_id").distinct()
    return ids.select("doc_id", identity.hash_bucket(F.col("doc_id"), identity.UPDATE_SALT).alias("update_bucket"), identity.hash_bucket(F.col("doc_id"), identity.RENAME_SALT).alias("rename_bucket"))


def hash_ranked_sample(spark, sf_dir):
    ids = table(spark, sf_dir, "doc_versions").select("doc_id").distinct()
    return hash_ranked(ids, "doc_id", "sample", SAMPLE)


def uuid5_ids(spark, sf_dir):
    """Each stored point with the id derived from its chunk."""
    return table(spark, sf_dir, "vector_copy").select("row_seq", identity.uuid5(F.col("chunk_id")).alias("point_id"))


def doc_paths(spark, sf_dir):
    """Documents whose id doesn't follow from the path of some snapshot."""
    made = text.doc_id_of(F.col("source_path"))
    return table(spark, sf_dir, "ledger_documents").select("doc_id", made.alias("made_id")).distinct()


def chunk_documents(spark, sf_dir):
    """Chunks of all pages that are no stubs."""
    pages = bodies(spark, sf_dir).where(~text.is_stub(F.col("body")))
    return chunk(pages, "doc_id", "body").drop("text")


def paragraph_units(spark, sf_dir):
    return cleaned(spark, sf_dir).select("doc_id", F.size(text.paragraphs(F.col("body"))).alias("n_paragraphs"))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rows.where(F.col("id") % EVERY == 0), rows


def knn_topk(spark, sf_dir):
    return exact_top_k(*_vectors(spark, sf_dir), K, exclude_self=False)


def knn_exclude_self(spark, sf_dir):
    return exact_top_k(*_vectors(spark, sf_dir), K, exclude_self=True)


def knn_hit_lists(spark, sf_dir):
    queries, rows = _vectors(spark, sf_dir)
    lists = with_empty(queries, exact_top_k(queries, rows, K))
    return lists.select("query_id", F.size("hits").alias("n_hits"), F.get("hits", F.lit(0))["match_id"].alias("first_match"))


def near_duplicates(spark, sf_dir):
    """A plain search on ``embeddings``: of every twentieth row the nearest other one, if at least so similar.

    Near-duplicate chunks, each of them judged, are ``near_duplicate_chunks``.
    """
    hits = exact_top_k(*_vectors(spark, sf_dir), 1)
    return hits.where(F.col("similarity") >= NEAR).select("query_id", "match_id", "similarity")


def self_match_control(spark, sf_dir):
    """Queries that find themselves first."""
    hits = exact_top_k(*_vectors(spark, sf_dir), K, exclude_self=False)
    return hits.agg(F.countDistinct("query_id").alias("n_queries"), F.sum((F.col("query_id") == F.col("match_id")).cast("int")).alias("n_found"))


def retrievability(spark, sf_dir):
    """Stored vectors, those of every twentieth write, that a search with their own vector finds within 5 and within 10."""
    stored = table(spark, sf_dir, "chunk_vectors").where("embedding is not null").select(F.col("row_seq").alias("id"), "embedding")
    hits = exact_top_k(stored.where(TWENTIETH), stored, K, exclude_self=False, dim=DIM)
    own = hits.where("query_id = match_id")
    return own.agg(F.sum((F.col("rank") <= 5).cast("int")).alias("in_top_5"), F.count("*").alias("in_top_10"))


def superseded_retrievable(spark, sf_dir):
    """How far chunks of versions that are no longer the last are still found: by id, by document and by text."""
    versions = table(spark, sf_dir, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("text_sha256").alias("text_sha256"), F.max("doc_id").alias("doc_id"), F.max("version_id").alias("version_id"))
    last = versions.where("doc_id is not null").groupBy("doc_id").agg(F.max("version_id").alias("last_version"))
    rows = table(spark, sf_dir, "chunk_vectors").select(F.col("row_seq").alias("id"), "chunk_id", "embedding").join(versions, "chunk_id")
    old = rows.where(TWENTIETH).join(last, "doc_id").where("version_id < last_version")
    return retrievable(old, exact_top_k(old, rows, K, exclude_self=False, dim=DIM), rows)


def embed_pages(spark, sf_dir):
    """Hashed vectors of the cleaned pages, each text embedded once; of the vector its largest number and where it stands."""
    pages = cleaned(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("body").alias("text"), F.sha2("body", 256).alias("text_sha256"))
    made = embed_by_hash(pages)
    top = F.array_max("embedding")
    return made.select(F.col("chunk_id").cast("bigint").alias("doc_id"), F.round(top.cast("double"), 4).alias("largest"), F.array_position("embedding", top).cast("int").alias("position"))


def vector_codec(spark, sf_dir):
    """Rows whose vector survives being written as a literal and read again."""
    rows = table(spark, sf_dir, "embeddings")
    back = vectors.parse_vector(vectors.vector_literal(F.col("embedding")))
    return rows.select("vec_id", (back == F.col("embedding")).alias("survives"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


def label_similarity(spark, sf_dir):
    """Mean cosine of each vector with the first of its label."""
    rows = table(spark, sf_dir, "embeddings")
    heads = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return rows.join(heads, "label").groupBy("label").agg(F.round(F.avg(vectors.cosine(F.col("embedding"), F.col("head"))), 6).alias("mean_similarity"), F.count("*").alias("n"))


NAMES = (
    clean_documents, stub_filter, dup_clusters, exact_dup_excess, canonical_documents, front_matter_split, front_matter_values, html_strip_pages, hash_bucket, hash_ranked_sample, uuid5_ids,
    doc_paths, chunk_documents, paragraph_units, knn_topk, knn_exclude_self, knn_hit_lists, near_duplicates, self_match_control, retrievability, superseded_retrievable, embed_pages, vector_codec, label_similarity,
)
QUERIES = {q.__name__: q for q in NAMES}

_WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_BODY = rf"""WITH RECURSIVE unixed AS (SELECT doc_id, text, regexp_replace(text, '\r\n?', chr(10), 'g') t, coalesce(path, 'page-' || doc_id) p FROM documents),
 plain AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '(?s)\A---\n(.*?)\n---\n', ''), '(?s)\{{\{{[%<]\s*.*?\s*[%>]\}}\}}', '', 'g'), '<[^>]+>', '', 'g') b FROM unixed),
 tidy AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A{_WS}+', ''), '{_WS}+\z', '') || chr(10) body FROM plain),
 cleaned AS (SELECT *, len(list_filter(string_split_regex(body, '{_WS}+'), lambda w: w <> '')) n_words,
     coalesce(nullif(regexp_extract(regexp_extract(t, '(?s)\A---\n(.*?)\n---\n', 1), '(?m)^title:[ \t]*["'']?(.*?)["'']?[ \t]*$', 1), ''), split_part(p, '/', -1)) title FROM tidy)
"""
# Windows over the units of each page: where a window ends and the next begins follows from the running sums of the units' tokens.
_NTOK = r"len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]'))"
_SOLID = rf"length(regexp_replace(@, '{_WS}', '', 'g')) > 0"
_UNITS = rf""",
 units AS (SELECT doc_id, flatten(list_transform(list_filter(string_split_regex(body, '\n\s*\n'), lambda p: {_SOLID.replace('@', 'p')}), lambda p: CASE WHEN {_NTOK.format('p')} <= 512 THEN [p] ELSE
     flatten(list_transform(list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(7), 'g'), chr(7)), lambda s: {_SOLID.replace('@', 's')}), lambda s: CASE WHEN {_NTOK.format('s')} <= 512 THEN [s] ELSE
     list_transform(range(0, {_NTOK.format('s')}, 512), lambda k: rtrim(array_to_string(regexp_extract_all(s, '(?:[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n])[ \t\r\n]*')[k + 1 : k + 512], ''))) END)) END)) u FROM cleaned),
 sums AS (SELECT doc_id, u, list_transform(range(0, len(u) + 1), lambda k: coalesce(list_sum(list_transform(u[1 : k], lambda x: {_NTOK.format('x')})), 0)::BIGINT) upto FROM units WHERE len(u) > 0),
 win AS (SELECT doc_id, 0 ordinal, 0 i, greatest(1, len(list_filter(upto, lambda x: x <= 512)) - 1) j FROM sums
     UNION ALL SELECT doc_id, ordinal + 1, i2, greatest(i2 + 1, len(list_filter(upto, lambda x: x <= upto[i2 + 1] + 512)) - 1) FROM (
         SELECT w.doc_id, ordinal, upto, greatest(least(len(list_filter(upto, lambda x: x <= upto[j + 1] - 77)) - 1, j), i + 1) i2 FROM win w JOIN sums USING (doc_id) WHERE j < len(u))),
 chunked AS (SELECT doc_id, ordinal::INT ordinal, array_to_string(u[i + 1 : j], chr(10) || chr(10)) t, (upto[j + 1] - upto[i + 1])::INT token_count FROM win JOIN sums USING (doc_id))
"""
_BUCKET = "(('0x' || substr({h}, 50, 15))::BIGINT % 100 + 76 * (('0x' || substr({h}, 1, 4))::BIGINT % 100 + ('0x' || substr({h}, 5, 15))::BIGINT % 100 + ('0x' || substr({h}, 20, 15))::BIGINT % 100 + ('0x' || substr({h}, 35, 15))::BIGINT % 100)) % 100"
_PAIRS = """WITH pairs AS (SELECT q.vec_id query_id, r.vec_id match_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) similarity
    FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 {but}),
 ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id))::INT AS rank, match_id, similarity FROM pairs)
"""
_ALL, _OTHERS = _PAIRS.format(but=""), _PAIRS.format(but="AND q.vec_id <> r.vec_id")

SQL = {
    "clean_documents": _BODY + "SELECT doc_id, title, sha256(body) content_sha256, length(body)::INT n_chars, n_words::INT n_words, n_words < 30 is_stub FROM cleaned",
    "stub_filter": _BODY + "SELECT doc_id FROM cleaned WHERE n_words >= 30",
    "dup_clusters": _BODY + "SELECT sha256(body) content_sha256, count(*) n_docs, min(doc_id) first_doc FROM cleaned GROUP BY 1 HAVING count(*) > 1",
    "exact_dup_excess": _BODY + "SELECT coalesce(sum(n - 1), 0)::BIGINT excess, count(*) clusters FROM (SELECT count(*) n FROM cleaned GROUP BY body HAVING count(*) > 1)",
    "canonical_documents": _BODY + "SELECT min(doc_id) doc_id, sha256(body) content_sha256 FROM cleaned GROUP BY body",
    "front_matter_split": _BODY + r"SELECT doc_id, length(regexp_extract(t, '(?s)\A---\n(.*?)\n---\n', 1))::INT front_chars, length(regexp_replace(t, '(?s)\A---\n(.*?)\n---\n', ''))::INT body_chars FROM unixed",
    "front_matter_values": _BODY + r""", lines AS (SELECT unnest(string_split(regexp_extract(t, '(?s)\A---\n(.*?)\n---\n', 1), chr(10))) l FROM unixed),
        fields AS (SELECT regexp_extract(l, $$^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*["']?(.*?)["']?[ \t]*\z$$, 1) k, regexp_extract(l, $$^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*["']?(.*?)["']?[ \t]*\z$$, 2) v FROM lines)
        SELECT k AS "key", count(*) n, count(DISTINCT v) n_values, max(v) greatest FROM fields WHERE k <> '' GROUP BY k""",
    "html_strip_pages": r"""SELECT doc_id, sha256(s) stripped_sha256 FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?s)\{\{[%<]\s*.*?\s*[%>]\}\}', '', 'g'), '<[^>]+>', '', 'g') s
        FROM documents) WHERE s <> text""",
    "hash_bucket": f"SELECT DISTINCT doc_id, ({_BUCKET.format(h="sha256('mode-a-update:' || doc_id)")})::INT update_bucket, ({_BUCKET.format(h="sha256('mode-d-rename:' || doc_id)")})::INT rename_bucket FROM doc_versions",
    "hash_ranked_sample": f"SELECT doc_id FROM (SELECT DISTINCT doc_id FROM doc_versions) ORDER BY sha256('sample:' || doc_id) LIMIT {SAMPLE}",
    "uuid5_ids": f"""SELECT row_seq, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1)
        || substr(h, 18, 3) || '-' || substr(h, 21, 12) point_id FROM (SELECT row_seq, sha1(unhex('{identity.POINT_NAMESPACE.replace("-", "")}') || encode(chunk_id)) h FROM vector_copy)""",
    "doc_paths": r"SELECT DISTINCT doc_id, regexp_replace(regexp_replace(source_path, '^(?:.*/)?content/handbook/', ''), '([^/])\.[^./]*$', '\1') made_id FROM ledger_documents",
    "chunk_documents": _BODY + _UNITS + "SELECT doc_id, ordinal, token_count, sha256(t) text_sha256 FROM chunked WHERE doc_id IN (SELECT doc_id FROM cleaned WHERE n_words >= 30)",
    "paragraph_units": _BODY + rf"SELECT doc_id, len(list_filter(string_split_regex(body, '\n\s*\n'), lambda p: length(regexp_replace(p, '{_WS}', '', 'g')) > 0))::INT n_paragraphs FROM cleaned",
    "knn_topk": _ALL + f"SELECT * FROM ranked WHERE rank <= {K}",
    "knn_exclude_self": _OTHERS + f"SELECT * FROM ranked WHERE rank <= {K}",
    "knn_hit_lists": _OTHERS + f"SELECT query_id, count(*)::INT n_hits, arg_min(match_id, rank) first_match FROM ranked WHERE rank <= {K} GROUP BY query_id",
    "near_duplicates": _OTHERS + f"SELECT query_id, match_id, similarity FROM ranked WHERE rank = 1 AND similarity >= {NEAR}",
    "self_match_control": _ALL + f"SELECT count(DISTINCT query_id) n_queries, sum((query_id = match_id)::INT)::BIGINT n_found FROM ranked WHERE rank <= {K}",
    "retrievability": f"""WITH v AS (SELECT row_seq, embedding::DOUBLE[] e FROM chunk_vectors WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
        ranked AS (SELECT q.row_seq q, r.row_seq m, row_number() OVER (PARTITION BY q.row_seq ORDER BY round(list_cosine_similarity(q.e, r.e), 6) DESC, r.row_seq) k
        FROM v q, v r WHERE (q.row_seq // 2) % 20 = 0) SELECT sum((k <= 5)::INT)::BIGINT in_top_5, count(*) in_top_10 FROM ranked WHERE q = m AND k <= {K}""",
    "superseded_retrievable": f"""WITH c AS (SELECT chunk_id, max(text_sha256) h, max(doc_id) d, max(version_id) v FROM chunks GROUP BY chunk_id),
        last AS (SELECT d, max(v) lv FROM c WHERE d IS NOT NULL GROUP BY d),
        r AS (SELECT row_seq, embedding, d, v, h FROM chunk_vectors JOIN c USING (chunk_id)),
        t AS (SELECT r.* FROM r JOIN last USING (d) WHERE (row_seq // 2) % 20 = 0 AND v < lv),
        ok AS (SELECT row_seq, embedding::DOUBLE[] e, d, h FROM r WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
        hits AS (SELECT q.row_seq q, o.row_seq m, o.d, o.h, row_number() OVER (PARTITION BY q.row_seq ORDER BY round(list_cosine_similarity(q.e, o.e), 6) DESC, o.row_seq) k
            FROM ok q, ok o WHERE q.row_seq IN (SELECT row_seq FROM t)),
        ranks AS (SELECT t.row_seq, min(k) FILTER (WHERE m = t.row_seq) exact_id, min(k) FILTER (WHERE hits.d = t.d) doc_scoped, min(k) FILTER (WHERE hits.h = t.h) content_scoped
            FROM t LEFT JOIN hits ON q = t.row_seq AND k <= {K} GROUP BY t.row_seq),
        long AS (FROM ranks UNPIVOT INCLUDE NULLS (a FOR mode IN (exact_id, doc_scoped, content_scoped)))
        SELECT k, mode, count(*) n_targets, sum((coalesce(a, 999) <= k)::INT)::BIGINT n_found FROM long, (VALUES (5), (10)) ks(k) GROUP BY ALL""",
    "embed_pages": _BODY + r"""SELECT doc_id, round(largest::DOUBLE, 4) largest, min(b)::INT + 1 AS position FROM (SELECT *, max(v) OVER (PARTITION BY doc_id) largest FROM (
        SELECT doc_id, b, (coalesce(s, 0) / sqrt(sum(s * s) OVER (PARTITION BY doc_id)))::FLOAT v, sum(s * s) OVER (PARTITION BY doc_id) n FROM
        (SELECT doc_id, unnest(range(64)) b FROM cleaned) grid LEFT JOIN (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 b, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::INT < 8 THEN 1 ELSE -1 END) s
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(body), '[a-z0-9_]+|[^A-Za-z0-9_ 	
]')) t FROM cleaned) GROUP BY ALL) USING (doc_id, b)) WHERE n > 0) WHERE v = largest GROUP BY doc_id, largest""",
    "vector_codec": "SELECT vec_id, true survives, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) norm FROM embeddings",
    "label_similarity": """SELECT label, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], h.head::DOUBLE[])), 6) mean_similarity, count(*) n
        FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) head FROM embeddings GROUP BY label) h USING (label) GROUP BY label""",
}
