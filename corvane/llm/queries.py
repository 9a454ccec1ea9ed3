"""Registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.bpe import op12_bpe_transducer
from corvane.llm.chat import OP4_SQL, op4_chat_format
from corvane.llm.decontaminate import op7_decontaminate
from corvane.llm.language import op9_language_id
from corvane.llm.lmscore import op5_lm_score
from corvane.llm.merkle import OP11_SQL, op11_merkle_manifest
from corvane.llm.mixing import op8_mix_sources
from corvane.llm.neardup import op3_minhash_neardup
from corvane.llm.secrets import op6_secret_scan
from corvane.llm.suffixdup import op2_suffix_dedup
from corvane.llm.tokenstore import op1_token_store
from corvane.llm.vectordup import op10_embedding_neardup
from corvane.llm.whitening import op13_embedding_whitening


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_minhash_neardup": op3_minhash_neardup,
        "op4_chat_format": op4_chat_format,
        "op5_lm_score": op5_lm_score,
        "op6_secret_scan": op6_secret_scan,
        "op7_decontaminate": op7_decontaminate,
        "op8_mix_sources": op8_mix_sources,
        "op9_language_id": op9_language_id,
        "op10_embedding_neardup": op10_embedding_neardup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_bpe_transducer": op12_bpe_transducer,
        "op13_embedding_whitening": op13_embedding_whitening,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op11_merkle_manifest": OP11_SQL}
