"""One contract query for each operator of this package: whole tables, production parameters."""

from __future__ import annotations

from . import aligntok, decontam, fim, langid, license, linededup, minhash, packing, quality, sharding, subword, tokenscan, warc
from .common import table
from .oracles import ORACLE  # noqa: F401


def op1_warc_index_merge(spark, sf_dir):
    return warc.capture_histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


def op2_license_scan(spark, sf_dir):
    return license.scan(table(spark, sf_dir, "documents"))


def op3_latent_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_hash_tree_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_nnls_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return linededup.digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return tokenscan.token_counts(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark, sf_dir):
    return aligntok.align(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    return fim.digest(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark, sf_dir):
    return subword.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_warc_index_merge, op2_license_scan, op3_latent_decontamination, op4_hash_tree_sharding, op5_quality_rules, op6_minhash_near_dedup, op7_nnls_packing, op8_line_dedup, op9_language_id, op10_token_counts, op11_cross_tokenizer_alignment, op12_fill_in_middle, op13_quality_classifier)
}

