"""Registers one query for each operator of this package."""

import public_tokenizers
from pyspark.sql import functions as F

from . import (letter_signatures, license_windows, neighbour_vote, one_permutation, parity_join, patched_blocks, pfair, prefix_counts, robust_outliers, segment_bounds, stable_tree,
               surrogates, swap_packing)
from .text import documents

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
KEY = b"a key for tests; a run of one's own passes a secret one"


def op1_neighbour_vote(spark, sf_dir):
    return neighbour_vote.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_robust_outliers(spark, sf_dir):
    return robust_outliers.judge(documents(spark, sf_dir))


def op3_parity_join(spark, sf_dir):
    return parity_join.linked_documents(documents(spark, sf_dir), words=3, percent=90)


def op4_surrogates(spark, sf_dir):
    return surrogates.anonymize(documents(spark, sf_dir).select("doc_id", "text"), KEY)


def op5_prefix_counts(spark, sf_dir):
    return prefix_counts.count_report(documents(spark, sf_dir), PIECES, 4096)


def op6_pfair_mix(spark, sf_dir):
    return pfair.mixture(documents(spark, sf_dir))


def op7_patched_blocks(spark, sf_dir):
    return patched_blocks.round_trip(documents(spark, sf_dir), WORDS, 1)


def op8_stable_tree(spark, sf_dir):
    return stable_tree.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op9_swap_packing(spark, sf_dir):
    return swap_packing.pack_documents(documents(spark, sf_dir), WORDS, 0, 2048)


def op10_license_windows(spark, sf_dir):
    return license_windows.find_notices(documents(spark, sf_dir))


def op11_letter_signatures(spark, sf_dir):
    return letter_signatures.variants(documents(spark, sf_dir))


def op12_segment_bounds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return segment_bounds.mine(rows.withColumn("label", label), "id % 50 = 0")


def op13_one_permutation(spark, sf_dir):
    return one_permutation.groups(documents(spark, sf_dir), words=3, percent=85)


QUERIES = {f.__name__: f for f in (op1_neighbour_vote, op2_robust_outliers, op3_parity_join, op4_surrogates, op5_prefix_counts, op6_pfair_mix,
                                   op7_patched_blocks, op8_stable_tree, op9_swap_packing, op10_license_windows, op11_letter_signatures, op12_segment_bounds, op13_one_permutation)}
ORACLES = {"op6_pfair_mix": pfair.ORACLE}
