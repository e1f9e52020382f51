"""From raw documents to packed sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of
``documents`` again; the last returns the pieces of the sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.langid import fit_languages, identify
from lakeloom.llm.line_dedup import line_dedup
from lakeloom.llm.near_dedup import near_dedup
from lakeloom.llm.packing import pack_documents
from lakeloom.llm.substring_dedup import substring_dedup
from lakeloom.session import remove, shared_dir, table


#: Languages that stay; None: all that the labelled documents have.
LANGUAGES: tuple[str, ...] | None = None
#: Share of a document that must be in these languages.
MIN_SHARE = 0.5
#: How much likelier (in logs) uniform noise must be than a document's mixture for the document to go; a few odd letters prove nothing.
NOISE = 20.0


def _same_columns(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with the number of characters brought up to date."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.length("text").cast(kind))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Documents in the wanted languages, with the predicted language in ``lang``.

    A document goes if its text is null or has no letter, if uniform noise is
    likelier by ``NOISE`` than its mixture of the learned languages (so it is in
    none of them), or if less than ``min_share`` of it is in the wanted ones.
    Repeated rows are kept, an empty table gives an empty one, other columns
    are passed on. Without labelled documents nothing is known of languages:
    only texts without a letter go.
    """
    model = fit_languages(docs)
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = [c for c in docs.columns if c != "text"]
    found = identify(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")), model, keep=("text", "row"))
    wanted = F.array(*[F.lit(x) for x in (model.names if languages is None else languages)])
    share = F.aggregate(F.zip_with("languages", "shares", lambda x, s: F.when(F.array_contains(wanted, x), s).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    stay = found.where((F.col("lang_pred") != "und") & (F.col("fit") > -NOISE) & (share >= min_share))
    return stay.select(*[F.col("text") if c == "text" else F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; documents with nothing left go.

    Null and blank texts have no line to lose and stay; repeated rows are one
    document and all stay or go; an empty table gives an empty one.
    """
    done = line_dedup(docs, carry=True)
    kept = done.where((F.col("_n_dropped") == 0) | (F.trim("_text") != ""))
    return _same_columns(kept.select(*[F.col("_text" if c == "text" else f"_row.`{c}`").alias(c) for c in docs.columns]), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8.

    Null and blank texts are copies of one another; of repeated rows one
    stays; an empty table gives an empty one.
    """
    return near_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that start earlier elsewhere go; documents with nothing left go.

    Null texts stay, blank ones go; repeated rows are one document and get the
    same text; an empty table gives an empty one.
    """
    done = substring_dedup(docs, min_words=50, carry=True)
    return _same_columns(done.where(F.col("text").isNull() | (F.trim("text") != "")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens at most.

    A null or empty text is its end mark; repeated rows are packed each for
    itself; an empty table gives an empty one; other columns are not looked at.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=200_000)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("substring dedup", passages), ("packing", packing)]

#: Trained models, min-hash shards and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:  # one copy of the corpus is enough
            remove(spark, f"{folder}/{n - 1}")
    return docs
