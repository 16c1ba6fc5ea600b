"""A corpus pipeline in five stages: language ID, exact dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Cases: a null text or one without a letter goes in the first stage; one of fewer than langid.REJECT_FROM letters and gaps stays there, as its
phrases say nothing. Documents are told apart by id and text together, so null and repeated ids
take nothing else with them; of repeated rows one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import bpe, exact_dedup, langid, mixing, simhash
from sparkfolio.llm.common import materialize, release, row_key, table, without_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the tokens that the mixture keeps.
BUDGET = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; those without a letter, or of noise, go."""
    key = row_key(docs, "doc_id", "text")
    found = langid.identify(docs.select(key.alias("_row"), "text"), langid.learn(docs), id_col="_row")
    gone = found.filter(~langid.accepted(F.col("lang_pred"), F.col("phrase_rate"), F.col("letters"))).select("_row")
    return without_rows(docs, materialize(gone, "rejected"), key)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints, that with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and topic shares are nearer to even, of BUDGET of the tokens."""
    return mixing.mix(docs, budget_share=BUDGET).filter("_selected").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, checked by decoding them."""
    import public_tokenizers

    found = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: Language ID, SimHash and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            release(before)  # the last stage's input stays: the result is lazy
    return docs
