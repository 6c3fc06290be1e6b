"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from salescope.llm import (decontam, kdshard, langid, linededup, merkle, mixing, neardup, pieces, pii, quality_clf, quality_rules,
                           tokens, turntrie)
from salescope.llm.common import ascii_lower, documents
from salescope.llm.oracles import ORACLE

N_SHARDS = 16
MIX_RATIO, MIX_EPOCHS = 1.5, 2.0


def op3_kd_tree_sharding(spark, sf_dir):
    return (kdshard.shard_documents(documents(spark, sf_dir), N_SHARDS)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def op4_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_mixing(spark, sf_dir):
    return (mixing.mix_plan(documents(spark, sf_dir), MIX_RATIO, MIX_EPOCHS)
            .select("doc_id", "size", "source_size", "target", "taken"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op2_pii(spark, sf_dir):
    found = pii.personal_data(documents(spark, sf_dir))
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    count = lambda i: F.size(F.filter("base", lambda m: m["ord"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(F.array_join(pii.all_spans(F.col("base"), none, none), ","), 256).alias("base_sha256"),
        F.array_join(pii.all_spans(F.col("base"), F.col("secrets"), F.col("found")), ",").alias("spans"),
        F.size("secrets").cast("long").alias("n_secret"),
        (F.size("base") + F.size("secrets") + F.size("found")).cast("long").alias("n_spans"))


def op6_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"),
        F.sha2("text", 256).alias("text_sha256"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op8_decontamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(documents(spark, sf_dir), benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_quality_classifier(spark, sf_dir):
    return quality_clf.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_output(spark, sf_dir):
    return tokens.token_output(documents(spark, sf_dir), tokenizer_file())


def op12_sentencepiece(spark, sf_dir):
    coded = pieces.encode_pieces(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark, sf_dir):
    # where 5 divides the checksum of the id, the holder's text has lost its capitals
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(changed, merkle.leaf_digest([*[F.col(c) for c in LEAF_COLUMNS[:-1]], ascii_lower(F.col("text"))]))
    out = merkle.manifest(documents(spark, sf_dir), "source", "doc_id", LEAF_COLUMNS, claimed)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_prefix_trie(spark, sf_dir):
    return turntrie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


LLM_QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_output": op10_token_output,
    "op3_kd_tree_sharding": op3_kd_tree_sharding,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_mixing": op5_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_merkle_manifest": op13_merkle_manifest,
}
LLM_ORACLE: dict[str, str] = dict(ORACLE)
