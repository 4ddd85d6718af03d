"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import additive_quantisation, bpe, lempel_ziv, packing, quality_model, quality_rules, secrets, sharding, simhash, token_counts


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_additive_quantisation": additive_quantisation.op1_additive_quantisation,
        "op2_separator_scan": token_counts.op2_separator_scan,
        "op3_extendible_shards": sharding.op3_extendible_shards,
        "op4_pair_index_bpe": bpe.op4_pair_index_bpe,
        "op5_credential_linking": secrets.op5_credential_linking,
        "op6_decision_list": quality_rules.op6_decision_list,
        "op7_simhash_components": simhash.op7_simhash_components,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_additive_quality": quality_model.op9_additive_quality,
        "op10_relative_lempel_ziv": lempel_ziv.op10_relative_lempel_ziv,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict:
    return {"op3_extendible_shards": sharding.OP3_SQL}
