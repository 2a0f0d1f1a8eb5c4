"""The queries of this subpackage and, where SQL can express one, their SQL."""

from __future__ import annotations

from plumbline.llm import pipeline
from plumbline.llm.bpe_codec import op3_byte_bpe
from plumbline.llm.chat_format import OP7_SQL, op7_chat_format
from plumbline.llm.decontaminate import op4_decontamination
from plumbline.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from plumbline.llm.importance import op12_importance
from plumbline.llm.langid import op2_language
from plumbline.llm.lm_score import op9_lm_score
from plumbline.llm.mixing import OP11_SQL, op11_mixing
from plumbline.llm.pii import op1_pii
from plumbline.llm.quality_rules import op8_quality_rules
from plumbline.llm.sharding import op6_sharding
from plumbline.llm.simhash_dedup import op10_simhash
from plumbline.llm.token_count import op5_token_counts


def queries():
    return {
        "pipeline": pipeline.run,
        "op1_pii": op1_pii,
        "op2_language": op2_language,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_decontamination": op4_decontamination,
        "op5_token_counts": op5_token_counts,
        "op6_sharding": op6_sharding,
        "op7_chat_format": op7_chat_format,
        "op8_quality_rules": op8_quality_rules,
        "op9_lm_score": op9_lm_score,
        "op10_simhash": op10_simhash,
        "op11_mixing": op11_mixing,
        "op12_importance": op12_importance,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql():
    return {"op7_chat_format": OP7_SQL, "op11_mixing": OP11_SQL, "op13_hard_negatives": OP13_SQL}
