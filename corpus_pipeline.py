"""A corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.

In all stages a row is a document: rows that share an id, or have none, are documents of their own. Texts of any length
are taken whole.
Extra columns of docs, whatever their names, don't matter and aren't returned. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import langid, packing, quality, simhash, substring
from stowage.llm.common import crc32_mod, cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The share of held-out documents that the language stage keeps.
KEPT = 0.999


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose score is under 0.7 go.

    Null and empty texts have a fixed score, that of the constant feature. Without any label all scores are 0.5, so
    nothing stays.
    """
    known = docs.select("doc_id", "text").filter(crc32_mod("doc_id", 4) != 2)
    weights = quality.fit(known, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    passed = quality.score(
        docs.select(F.struct(*COLUMNS).alias("row"), "text"), weights, "row", "text"
    ).filter("score >= 0.7")
    return passed.select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents go in which no language is found, or none that is as sure as KEPT of the held-out
    documents.

    A forced vote between two names always scores 0.5 or more, so the level is that of labelled documents the model
    wasn't fitted on and names rightly;
    0.5 where there are none. Null texts and texts without a letter go; so does everything if no document has a
    language. Ties with the level stay.
    """
    model = langid.fit(docs.filter(crc32_mod("doc_id", 3) != 1), "doc_id", "text", "lang")
    held = docs.filter((crc32_mod("doc_id", 3) == 1) & F.col("lang").isNotNull())
    right = langid.predict(
        held.select(F.col("lang").alias("row"), "text"), model, "row", "text"
    ).filter("row = lang_pred")
    level = right.agg(F.percentile_approx("score", F.lit(1 - KEPT), F.lit(100_000))).first()[0] or 0.5
    said = langid.predict(docs.select(F.struct(*COLUMNS).alias("row"), "text"), model, "row", "text")
    return said.filter((F.col("lang_pred") != "und") & (F.col("score") >= F.lit(level))).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near-duplicates one row stays, of those with the smallest id.

    Documents are linked whose fingerprints of five-word shingles differ in at most 4 bits, and those that have 4/5 of these
    shingles in common, which a prefix filter finds where 64 bits miss them. Rows are told apart by a number of their own, so of repeated rows,
    and of rows with a null id,
    one stays as of other copies; an id that isn't null is preferred. Texts without a word, null or empty, are alike:
    one of them stays.
    """
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("n")), "rows")
    found = cut(simhash.near_copies(rows.select("n", "text")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n"))["n"]
    stay = rows.select("n", "doc_id").join(found, "n").groupBy("root").agg(first.alias("n")).select("n")
    return rows.join(stay, "n", "left_semi").select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: passages of 50 words and more that a document with a smaller id has too are cut.

    A null text stays null with its n_chars; a document all of whose words go stays with an empty text; a null id
    neither cuts nor is cut.
    """
    less = substring.cut_repeats(docs.select(*COLUMNS), "doc_id", "text", length=50)
    return less.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: what is left, in sequences of at most 2048 tokens. A null or empty text is its end id alone."""
    return packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", keep_good),
    ("language id", keep_languages),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_passages),
    ("best-fit packing", pack),
]

#: Fitted models and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
