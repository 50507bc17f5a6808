"""The queries of this folder by name, and SQL for those that SQL can express."""

from veilframe.llm import decontaminate, language_id, packing, quality_classifier, quality_rules, secrets, simhash, substring_dedup, token_counts, warc

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_simhash_dedup": simhash.op2,
    "op3_decontamination": decontaminate.op3,
    "op4_substring_dedup": substring_dedup.op4,
    "op5_quality_classifier": quality_classifier.op5,
    "op6_warc_index": warc.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_language_id": language_id.op8,
    "op9_quality_rules": quality_rules.op9,
    "quality_base_counts": quality_rules.base_counts,
    "op10_token_counts": token_counts.op10,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.ORACLE,
    "op3_decontamination": decontaminate.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op6_warc_index": warc.ORACLE,
    "quality_base_counts": quality_rules.BASE_ORACLE,
}
