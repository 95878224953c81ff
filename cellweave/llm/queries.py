"""The opN queries of this subpackage; a query's module is loaded when it runs."""

from __future__ import annotations

import importlib

from cellweave.llm.oracles import block_negatives, certified_rules, merkle_manifest

MODULES = {
    "op1_warc_derivatives": "warc",
    "op2_near_duplicates": "near_dedup",
    "op3_line_crf": "line_crf",
    "op4_lexical_packing": "packing",
    "op5_chat_windows": "chat",
    "op6_motion_jpeg": "avi",
    "op7_certified_rules": "quality_rules",
    "op8_line_blocks": "html_text",
    "op9_label_shards": "shards",
    "op10_byte_bpe": "bpe",
    "op11_block_negatives": "hard_negatives",
    "op12_merkle_manifest": "merkle",
    "op13_sentence_toxicity": "toxicity",
}


def _lazy(module: str):
    def run(spark, sf_dir):
        return importlib.import_module(f"cellweave.llm.{module}").query(spark, sf_dir)

    return run


QUERIES = {name: _lazy(module) for name, module in MODULES.items()}
ORACLES: dict[str, str] = {"op7_certified_rules": certified_rules(), "op11_block_negatives": block_negatives(), "op12_merkle_manifest": merkle_manifest()}
