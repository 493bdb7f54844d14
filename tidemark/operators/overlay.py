"""A synthetic staff directory laid over a corpus, to follow personal data through an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import chunk_id
from tidemark.operators.chunker import chunk
from tidemark.operators.ledger import per_engine, purge
from tidemark.operators.ordering import dense_ids

FOLDER = "synthetic/employee"
FIRST = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hal", "Ida", "Jon", "Kim", "Lea")
LAST = ("Arden", "Birk", "Cole", "Dorn", "Ewing", "Foss", "Grey", "Holt", "Innes", "Jarl")
ROLES = ("engineer", "analyst", "designer", "recruiter", "counsel", "accountant")
CITIES = ("Northby", "Eastham", "Southwick", "Westford")


def _pick(words: tuple[str, ...], seed: int, what: str) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(F.lit(f"{seed}:{what}"), F.col("n")), F.lit(len(words))) + 1).cast("int"))


def employees(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """n made-up employees, the same for the same seed."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "n").withColumn("employee_id", F.format_string("SYN-%04d", "n"))
    rows = rows.withColumns({"first": _pick(FIRST, seed, "first"), "last": _pick(LAST, seed, "last"), "role": _pick(ROLES, seed, "role"), "city": _pick(CITIES, seed, "city")})
    phone = F.format_string("555-%04d", F.pmod(F.xxhash64(F.lit(f"{seed}:phone"), F.col("n")), F.lit(10000)))
    return rows.withColumns({"phone": phone, "email": F.lower(F.concat_ws(".", "first", "last", "employee_id"))}).withColumn("email", F.concat("email", F.lit("@example.invalid")))


def profile_pages(people: DataFrame) -> DataFrame:
    """(doc_id, title, body): one page per employee, long enough to be no stub and short enough to be one chunk."""
    name = F.concat_ws(" ", "first", "last")
    body = F.concat_ws(
        "\n",
        F.format_string("# %s", name),
        F.lit(""),
        F.format_string("%s works as %s from our place in %s and has the staff number %s.", name, F.col("role"), F.col("city"), F.col("employee_id")),
        F.format_string("Write to %s or call %s during the usual hours; in urgent cases leave a message, and it will be answered on the next day.", F.col("email"), F.col("phone")),
        F.lit(""),
    )
    return people.select(F.concat(F.lit(f"{FOLDER}/"), "employee_id").alias("doc_id"), name.alias("title"), body.alias("body"))


def _conformed(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns and types of another table; those that it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def migrate(documents: DataFrame, versions: DataFrame, chunks: DataFrame, events: DataFrame, legacy_doc: str | None, pages: DataFrame, commit: str) -> dict[str, DataFrame]:
    """The ledger without the legacy document and with one live synthetic document per page, its version, its chunks and an upsert of each in every engine.

    Pages whose documents are there already are left as they are, so a second run changes nothing. New versions and events are numbered
    after those that there are.
    """
    spark = documents.sparkSession
    left = purge(documents, versions, chunks, events, spark.createDataFrame([(legacy_doc,)], "doc_id string"))
    fresh = pages.join(left["documents"].select("doc_id"), "doc_id", "left_anti")
    after = lambda df, c: df.agg(F.coalesce(F.max(c), F.lit(0)).cast("bigint")).first()[0]
    docs = fresh.select(
        "doc_id",
        F.concat(F.lit("synthetic:"), "doc_id", F.lit(".md")).alias("source_path"),
        F.lit(commit).alias("first_seen_commit"),
        F.lit(commit).alias("last_seen_commit"),
        F.lit("live").alias("status"),
        F.lit(None).cast("string").alias("renamed_to"),
        F.lit(1).alias("is_synthetic_pii"),
    )
    numbered = dense_ids(fresh.select("doc_id", "body"), ["doc_id"], "version_id", after(left["doc_versions"], "version_id") + 1)
    made = numbered.select("doc_id", "version_id", "body", F.lit(commit).alias("commit_sha"), F.sha2("body", 256).alias("content_sha256"), F.lit("add").alias("action"))
    parts = chunk(numbered, "doc_id", "body").join(numbered.select("doc_id", "version_id"), "doc_id")
    parts = parts.select(chunk_id(F.col("doc_id"), F.col("version_id"), F.col("ordinal")).alias("chunk_id"), "doc_id", "version_id", "ordinal", "text_sha256", "token_count")
    upserts = per_engine(parts.select("chunk_id")).withColumns({"op": F.lit("upsert"), "commit_sha": F.lit(commit), "expected_present": F.lit(1)})
    logged = dense_ids(upserts, ["engine", "chunk_id"], "event_id", after(left["index_events"], "event_id") + 1)
    new = {"documents": docs, "doc_versions": made, "chunks": parts, "index_events": logged}
    return {name: df.unionByName(_conformed(new[name], df)) for name, df in left.items()}
