"""The queries of this subpackage, for the driver's entry points."""

from __future__ import annotations

import corpus_pipeline
from tessella.llm import decontaminate, language, mixing, nearest, pii, secrets, simhash, token_files, toxicity, urls

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_files": token_files.op3_token_files,
    "op4_mixing": mixing.op4_mixing,
    "op5_urls": urls.op5_urls,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language": language.op7_language,
    "op8_nearest": nearest.op8_nearest,
    "op9_pii": pii.op9_pii,
    "op10_decontamination": decontaminate.op10_decontamination,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {"op5_urls": urls.ORACLE}
