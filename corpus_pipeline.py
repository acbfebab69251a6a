"""From documents to packed sequences: quality, near copies, personal data, mixing, packing.

Each stage takes the documents that the one before kept and returns documents (the last: packed pieces). ``run`` writes each
stage's result to the shared folder and reads it again, so that lost executors cost one stage at most.
"""

from shelfwise.llm import neighbour_vote, parity_join, pfair, surrogates, swap_packing
from shelfwise.llm.queries import KEY, WORDS
from shelfwise.llm.text import MEMO, documents
from shelfwise.session import materialize

#: The votes of neighbours, the search for near copies and the packing have no SQL; tests/llm holds ``run`` against plain Python.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents with a quality score of at least 0.3; others go."""
    return neighbour_vote.keep(docs, neighbour_vote.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


def near_copies(spark, docs, sf_dir):
    """One document, that of smallest id, of each group linked by a Jaccard similarity of at least 0.8 on five-word shingles."""
    return parity_join.one_of_each(docs, words=5, percent=80)


def personal_data(spark, docs, sf_dir):
    """All documents, with surrogates for personal data in their texts and n_chars to match."""
    from pyspark.sql import functions as F
    return surrogates.anonymize(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """All documents, in the order of the mixture by target weights, in files that follow one another."""
    return pfair.mix(docs, ordered=True).select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of all documents, packed into sequences of at most 2048 tokens, by ranges of the mixture, which is the order of the
    files and of the rows in them."""
    return swap_packing.pack_documents(docs, WORDS, end_id=0, capacity=2048, ordered=True, runs=MEMO)


STAGES = [("quality", quality), ("near_copies", near_copies), ("personal_data", personal_data), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
