"""Queries of the problems on texts and vectors for language models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.leaks import find_leaks, leak_shares
from tidemark.llm.neighbours import similar_pairs, top_similar
from tidemark.llm.packing import pack
from tidemark.llm.split import LEEWAY, LIMIT, OVERLAP, split_oversized
from tidemark.llm.subjects import assign_subjects
from tidemark.llm.tokens import spaced_tokens, token_count
from tidemark.session import cut_lineage, table, texts

CONTAINER = 2048
NEIGHBOURS = 5
LEAST_SIMILARITY = 0.85


def oversized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = texts(spark, sf_dir, "cleaned_docs").select(F.lit("body").alias("item_kind"), F.col("clean_id").alias("item_id"), F.col("body").alias("text"))
    spans = texts(spark, sf_dir, "chunk_spans").select(F.lit("span").alias("item_kind"), F.col("span_id").alias("item_id"), "text")
    return bodies.unionByName(spans)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every body and span, whole ones included."""
    return split_oversized(oversized_items(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("pieces > 1 and piece = 0").select("item_kind", "item_id")


def p1_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text put together again from its pieces without their overlaps, and how many pieces pass the limit or overlap too little."""
    pieces = p1_pieces(spark, sf_dir)
    new = F.slice(spaced_tokens(F.col("text")), F.col("overlap_tokens") + 1, F.greatest(F.col("token_count"), F.lit(1)))
    own = F.when(F.col("overlap_tokens") == 0, F.col("text")).otherwise(F.array_join(new, ""))
    each = pieces.withColumns({"own": own, "counted": token_count(F.col("text"))})
    whole = each.groupBy("item_kind", "item_id").agg(
        F.sort_array(F.collect_list(F.struct("piece", "own"))).alias("parts"),  # the pieces of one text
        F.sum(F.col("token_count") - F.col("overlap_tokens")).alias("tokens"),
        F.count_if((F.col("counted") != F.col("token_count")) | (F.col("counted") > LIMIT)).alias("n_wrong"),
        F.count_if((F.col("piece") > 0) & ~F.col("overlap_tokens").between(OVERLAP, OVERLAP + LEEWAY)).alias("n_short"),
    )
    text = F.array_join(F.transform("parts", lambda x: x["own"]), "")
    return whole.select("item_kind", "item_id", F.sha2(text, 256).alias("text_sha256"), "tokens", "n_wrong", "n_short")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), token_count(F.col("text")).alias("tokens"))
    return pack(cut_lineage(sizes), CONTAINER)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(spark, sf_dir).where("piece = 1").select(F.col("item").alias("doc_id"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every container with its pages and tokens."""
    return containers(spark, sf_dir).groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("tokens").alias("tokens"))


def p7_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its tokens, the pieces that it lies in, and whether one of its containers is overfull or holds a piece twice."""
    placed = cut_lineage(containers(spark, sf_dir))
    load = placed.groupBy("container").agg((F.sum("tokens") > CONTAINER).alias("is_overfull"))
    own = placed.join(load, "container").groupBy(F.col("item").alias("doc_id"))
    wrong = F.max("is_overfull") | (F.count("*") != F.countDistinct("piece"))
    return own.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_pieces"), wrong.alias("is_wrong"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar of every vector, with their places and similarities, where at least 0.85."""
    return top_similar(table(spark, sf_dir, "chunk_vectors"), NEIGHBOURS, LEAST_SIMILARITY)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(p5_neighbours(spark, sf_dir), LEAST_SIMILARITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def plain_sentences(df: DataFrame, key: str) -> DataFrame:
    """(key, sentence, n_words): sentences of six words and more that are no questions, in plain lower-case words."""
    lines = F.split(F.regexp_replace("text", r"([.!?])\s+|[\r\n]+", "$1\n"), "\n")
    each = df.select(key, F.explode(lines).alias("line")).where(~F.col("line").endswith("?"))
    plain = each.select(key, F.trim(F.regexp_replace(F.lower(F.regexp_replace("line", r"^.*:\s", "")), "[^a-z0-9]+", " ")).alias("sentence")).distinct()
    return plain.withColumn("n_words", F.size(F.split("sentence", " "))).where("n_words >= 6")


def p8_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of p8_found that hold three fifths of an item's sentences word by word; sentences of three or more items don't count."""
    own = plain_sentences(table(spark, sf_dir, "eval_items"), "item_id")
    own = own.join(own.groupBy("sentence").count().where("count < 3").select("sentence"), "sentence")
    size = own.groupBy("item_id").agg(F.sum("n_words").alias("of_item"))
    met = plain_sentences(texts(spark, sf_dir, "documents"), "doc_id").join(own.select("sentence", "item_id"), "sentence")
    held = met.groupBy("doc_id", "item_id").agg(F.sum("n_words").alias("n")).join(size, "item_id").where(F.col("n") >= 0.6 * F.col("of_item"))
    return held.select("doc_id", "item_id").join(p8_found(spark, sf_dir), ["doc_id", "item_id"], "left_semi")


def p8_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages hold how much of each item, in tenths of its passage."""
    shares = leak_shares(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return shares.groupBy("item_id", F.floor(F.col("share") * 10).cast("int").alias("tenths")).agg(F.count("*").alias("n_pages"))


def page_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_subjects(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_subjects(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: pages, and sentences on the subject within them."""
    return page_subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_pages"), F.sum("sentences").alias("n_sentences"))


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, and whether it has one to four different subjects of the list, as quarters allow."""
    areas = table(spark, sf_dir, "subject_areas").select("subject", F.lit(True).alias("known"))
    each = page_subjects(spark, sf_dir).join(F.broadcast(areas), "subject", "left")  # the list is short and fixed
    valid = F.count("*").between(1, 4) & (F.count("known") == F.count("*")) & (F.countDistinct("subject") == F.count("*"))
    return each.groupBy("doc_id").agg(valid.alias("is_valid"))


QUERIES = {
    "p1_round_trip": p1_round_trip,
    "p7_placements": p7_placements,
    "p8_verbatim": p8_verbatim,
    "p9_pages": p9_pages,
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_by_item": p8_by_item,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_TOKENS = r"len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]'))"

# Equal to the index's result where all cells are visited, as they are at the scales up to 0.01.
_NEAR = f"""WITH v AS (SELECT chunk_id, arg_max(struct_pack(e := embedding), row_seq).e::DOUBLE[] e FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
 u AS (SELECT * FROM v WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL)) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
 pairs AS (SELECT a.chunk_id, b.chunk_id other, round(list_cosine_similarity(a.e, b.e), 6) similarity FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
 near AS (SELECT *, (row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, other))::INT place FROM pairs WHERE similarity >= {LEAST_SIMILARITY})"""
_PLAIN = r"""SELECT DISTINCT {key}, s, len(string_split(s, ' ')) n FROM (SELECT {key}, trim(regexp_replace(lower(regexp_replace(line, '^.*:\s', '')), '[^a-z0-9]+', ' ', 'g'), ' ') s
     FROM (SELECT {key}, unnest(string_split(regexp_replace(text, '([.!?])\s+|[\r\n]+', '\1' || chr(10), 'g'), chr(10))) line FROM {table}) WHERE NOT suffix(line, '?')) WHERE len(string_split(s, ' ')) >= 6"""

SQL = {
    "p1_found": f"""SELECT 'body' item_kind, clean_id item_id FROM cleaned_docs WHERE {_TOKENS.format('body')} > {LIMIT}
        UNION ALL SELECT 'span', span_id FROM chunk_spans WHERE {_TOKENS.format('text')} > {LIMIT}""",
    "p1_round_trip": f"""SELECT *, 0::BIGINT n_wrong, 0::BIGINT n_short FROM (SELECT 'body' item_kind, clean_id item_id, sha256(body) text_sha256, {_TOKENS.format('body')} tokens FROM cleaned_docs WHERE body IS NOT NULL
        UNION ALL SELECT 'span', span_id, sha256(text), {_TOKENS.format('text')} FROM chunk_spans WHERE text IS NOT NULL)""",
    "p5_found": _NEAR + f" SELECT DISTINCT least(chunk_id, other) chunk_id_a, greatest(chunk_id, other) chunk_id_b FROM near WHERE place <= {NEIGHBOURS}",
    "p5_neighbours": _NEAR + f" SELECT chunk_id, place, other, similarity FROM near WHERE place <= {NEIGHBOURS}",
    "p7_found": f"SELECT doc_id FROM documents WHERE {_TOKENS.format('text')} > {CONTAINER}",
    "p7_placements": f"""SELECT doc_id, n tokens, greatest(1, (n + {CONTAINER - 1}) // {CONTAINER}) n_pieces, false is_wrong FROM (SELECT doc_id, coalesce({_TOKENS.format('text')}, 0)::BIGINT n FROM documents)""",
    "p8_verbatim": f"""WITH every AS ({_PLAIN.format(key='item_id', table='eval_items')}), own AS (SELECT * FROM every WHERE s IN (SELECT s FROM every GROUP BY s HAVING count(*) < 3)),
        page AS ({_PLAIN.format(key='doc_id', table='documents')}) SELECT doc_id, item_id FROM (SELECT doc_id, item_id, sum(own.n) n FROM page JOIN own USING (s) GROUP BY ALL)
        JOIN (SELECT item_id, sum(n) of_item FROM own GROUP BY item_id) USING (item_id) WHERE n >= 0.6 * of_item""",
    "p9_pages": "SELECT doc_id, true is_valid FROM documents",
}
