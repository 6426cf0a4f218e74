"""The registered queries: thin applications of the operators to the whole
tables with production parameters."""

from __future__ import annotations

import public_tokenizers

from quarry.llm import (bpe_count, cross_polytope, duck_bpe, fingerprints, fm_index, id_codec, jaccard_join, langid, mixing,
                        reshard, secrets_scan, turn_repair, whitening)
from quarry.llm.common import table

TOKEN_LIMIT = 4096


def op1_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    return secrets_scan.findings(table(spark, sf_dir, "documents"))


def op4_token_id_output(spark, sf_dir):
    return id_codec.encoded_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_embedding_near_dedup(spark, sf_dir):
    return cross_polytope.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op7_token_counts(spark, sf_dir):
    return bpe_count.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op8_resharding(spark, sf_dir):
    return reshard.balanced(table(spark, sf_dir, "documents"), n_shards=16)


def op9_language_id(spark, sf_dir):
    return langid.held_out_languages(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark, sf_dir):
    return duck_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark, sf_dir):
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")))


def op13_decontamination(spark, sf_dir):
    return fm_index.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mixing": op2_mixing,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_id_output": op4_token_id_output,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_resharding": op8_resharding,
    "op9_language_id": op9_language_id,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_whitening": op11_whitening,
    "op12_turn_repair": op12_turn_repair,
    "op13_decontamination": op13_decontamination,
}
