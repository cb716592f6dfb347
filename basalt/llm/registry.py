"""The operators' queries by name, with DuckDB equivalents where SQL can express them."""

from . import chat_format, decontamination, exact_dedup, language_id, line_dedup, near_dedup, packing, secret_scan, sharding, toxicity

QUERIES = {
    "op1_chat_formatting": chat_format.op1_chat_formatting,
    "op2_packing": packing.op2_packing,
    "op3_sharding": sharding.op3_sharding,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_language_id": language_id.op5_language_id,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLES: dict[str, str] = {"op6_exact_dedup": exact_dedup.ORACLE, "op7_minhash_near_dedup": near_dedup.ORACLE}
