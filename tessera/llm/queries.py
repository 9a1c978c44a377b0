"""The queries of this subpackage, opN_<name>, and the SQL that some of them equal."""

from __future__ import annotations

from tessera.llm import bpe, decontaminate, langid, minhash, quality_knn, quality_rules, substring, surrogates, toxicity, warc

QUERIES = {
    "op1_surrogates": surrogates.query,
    "op2_quality_knn": quality_knn.query,
    "op3_decontaminate": decontaminate.query,
    "op4_toxicity_levenshtein": toxicity.query,
    "op5_warc": warc.query,
    "op6_minhash": minhash.query,
    "op7_quality_rules": quality_rules.query,
    "op8_language_kernel": langid.query,
    "op9_substring": substring.query,
    "op10_byte_bpe": bpe.query,
}
ORACLES: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_minhash": minhash.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op9_substring": substring.ORACLE,
}
