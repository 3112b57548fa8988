"""A training corpus from ``documents``: language ID, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import base, jaccard, language_id, packing, quality

#: Texts whose own language holds less than this part of the share of trigrams that it holds of its labelled texts are in none of the
#: learned languages.
LEAST_LANGUAGE_SCORE = 0.25
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def _whole(docs: DataFrame) -> DataFrame:
    """row (all columns as they are), doc_id, text: names that a stage adds can't clash with the documents' own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are ``und`` (null, or without letters) or in no language that the labelled rows teach.

    Without any labelled row there is nothing to tell languages by, and only texts without letters go.
    """
    model = language_id.train(docs)
    rated = language_id.identify(_whole(docs), model, keep=True)
    if model.languages:
        reach = F.create_map(*(F.lit(x) for pair in model.reach.items() for x in pair))[F.col("lang_pred")]
        kept = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE * reach)
    else:
        kept = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    return rated.where(kept).select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a base rule or the likelihood ratio; the target is ``labels``' good documents among ``docs``."""
    rows = base.id_and_text(docs)
    weights = quality.fit(rows, quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(quality.base_rules(_whole(docs)), weights).where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: that with the smallest doc_id (null last), of several with that id the one with the least hash.

    Rows are told apart by a 64-bit hash of id and text, so rows that share an id, or have none, are compared like others; of exact
    repeats of both, one stays. Rows to keep are chosen by id and hash alone. Each task sends one of the repeats that it has read, so that a
    row which a third of the table repeats arrives once a task, and the documents are shuffled once, for the join with the rows to keep.
    """
    unnamed, empty = F.col("doc_id").isNull(), F.col("text").isNull()
    keyed = _whole(docs).withColumn("tie", F.xxhash64(F.coalesce("doc_id", F.lit(0)), unnamed, F.coalesce("text", F.lit("")), empty))
    groups = jaccard.jaccard_components(keyed, SHINGLE_WORDS, SIMILARITY_PERCENT, id_col="tie").select(F.col("doc_id").alias("tie"), "component_id").distinct()
    named = keyed.select("tie", "doc_id").distinct()
    kept = groups.join(named, "tie").groupBy("component_id").agg(F.min_by("tie", F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("tie")).select("tie")
    once = keyed.groupBy("tie").agg(F.first("row").alias("row"))
    return once.join(kept, "tie", "left_semi").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's tokens, packed into sequences of 2,048."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: The stages are a trained filter, a hashed model, a join by hashes and a packing: no SQL gives their rows. tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = base.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
