"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bpe import encode_and_decode
from pathloom.llm.common import store
from pathloom.llm.decontaminate import without_contaminated
from pathloom.llm.jaccard_join import jaccard_components
from pathloom.llm.language_id import held_out, identify, train
from pathloom.llm.pii import pseudonymise
from pathloom.llm.queries import PII_KEY, TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts that are null or hold no letter go.

    The model learns from the rows of ``docs`` outside the held-out fold that have a language. Rows are judged one by one, so
    repeated rows and rows with a null id stay or go alike; of equal scores the first language in order wins, which decides
    nothing here. All columns stay as they were, whatever their names; no rows give no rows.
    """
    return identify(docs, train(docs.where(~held_out()))).where("lang_pred <> 'und'").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, nulls last, and of rows that share it the first.

    Every row is a document of its own, so repeated rows, rows with a null id and rows that share an id go unless first of
    their group; null texts and texts without words link with nothing and stay. Other columns may have any names; no rows
    give no rows.
    """
    # Row numbers hold only in a written table.
    rows = store(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("no")))
    own = jaccard_components(rows, id_col="no", text_col="row.text").select(F.col("doc_id").alias("no"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "no")
    kept = rows.select("no", "row.doc_id").join(own, "no").groupBy("component_id").agg(F.min(order)["no"].alias("no")).select("no")
    return rows.join(kept, "no", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth, or none, lie in benchmark windows.

    Null and empty texts have no words and stay; rows are judged one by one, so repeated rows and rows with a null id stay or go
    alike; a text with exactly a twentieth goes. All columns stay as they were, whatever their names; no rows give no rows.
    """
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts and ``n_chars``, where there is such a column, as the new texts have it.

    A null text stays null and its ``n_chars`` gets null; equal values get equal pseudonyms, in repeated rows as well. Other columns
    stay as they were but for one named ``pii``, which the operator replaces and this stage puts back; no rows give no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    done = pseudonymise(docs.select(F.struct(F.lit(0).alias("__none"), *others).alias("row"), "text"), PII_KEY)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and the digest of the decoded text.

    A null text counts as empty and has no ids; repeated rows and rows with a null id get a row each; other columns, whatever
    their names, are left behind; no rows give no rows.
    """
    done = encode_and_decode(docs, TOKENIZER, carry=["doc_id"])
    return done.select("row.doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]
#: Language models and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as a table and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
