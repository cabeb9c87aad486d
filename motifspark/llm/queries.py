"""Queries of this subpackage and their SQL."""
from __future__ import annotations

from . import bpe, decontaminate, langid, language_model, licenses, line_dedup, merkle, quality_model, quality_rules, secret_scan, simhash, toxicity, turn_repair


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_bpe": bpe.op2_bpe,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_langid": langid.op5_langid,
        "op6_simhash": simhash.op6_simhash,
        "op7_quality_model": quality_model.op7_quality_model,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_language_model": language_model.op9_language_model,
        "op10_licenses": licenses.op10_licenses,
        "op11_merkle": merkle.op11_merkle,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_turn_repair": turn_repair.op13_turn_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op8_decontaminate": decontaminate.ORACLE,
        "op10_licenses": licenses.ORACLE,
        "op11_merkle": merkle.ORACLE,
        "op12_line_dedup": line_dedup.ORACLE,
        "op13_turn_repair": turn_repair.ORACLE,
    }
