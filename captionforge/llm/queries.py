"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fingerprints, htmlcrf, langid, mixing, neardup, pii, secrets, tokenpack, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.op1_secrets,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_html_text": htmlcrf.op5_html_text,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash_fingerprints": fingerprints.op7_simhash_fingerprints,
    "op8_token_ids": tokenpack.op8_token_ids,
    "op9_simhash_near_dedup": neardup.op9_simhash_near_dedup,
    "op10_language_id": langid.op10_language_id,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE_OP3,
    "op4_decontamination": decontam.ORACLE_OP4,
}
