"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import importlib

#: Query names by module; each query is the module's function of that name, its SQL the module's ORACLE.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_chat_format": "chat_format",
    "op3_lm_scoring": "lm_scoring",
    "op4_packing": "packing",
    "op5_near_duplicates": "minhash_dedup",
    "op6_sentencepiece": "sentencepiece_codec",
    "op7_quality_rules": "quality_rules",
    "op8_exact_dedup": "exact_dedup",
    "op9_html_extraction": "html_extraction",
    "op10_pii": "pii",
    "op11_periodic_runs": "periodic_runs",
    "op12_warc": "warc",
    "op13_spelling_variants": "spelling_variants",
}


def _module(name: str):
    return importlib.import_module(f"strataline.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).ORACLE for name in MODULES if hasattr(_module(name), "ORACLE")}
