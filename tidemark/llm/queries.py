"""The registered corpus queries and, where SQL can say it, their oracles."""

from __future__ import annotations

from tidemark.llm import oracles
from tidemark.llm.collocations import ORACLE as COLLOCATIONS_SQL
from tidemark.llm.collocations import op13_collocations
from tidemark.llm.html import op2_html_extraction
from tidemark.llm.langid import op6_language_id
from tidemark.llm.merkle import ORACLE as MERKLE_SQL
from tidemark.llm.merkle import op11_merkle_manifest
from tidemark.llm.mixing import ORACLE as MIXING_SQL
from tidemark.llm.mixing import op9_mixing
from tidemark.llm.neardup import op3_fingerprints, op8_simhash_neardup
from tidemark.llm.packing import op4_packing
from tidemark.llm.pii import op1_pii
from tidemark.llm.quality import ORACLE as QUALITY_SQL
from tidemark.llm.quality import op10_quality_rules
from tidemark.llm.secrets import op5_secret_scans
from tidemark.llm.substrings import op7_substring_dedup
from tidemark.llm.tokenids import op12_token_ids

QUERIES = {
    "op1_pii": op1_pii,
    "op2_html_extraction": op2_html_extraction,
    "op3_document_fingerprints": op3_fingerprints,
    "op4_packing": op4_packing,
    "op5_secret_scans": op5_secret_scans,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash_near_dedup": op8_simhash_neardup,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_ids": op12_token_ids,
    "op13_phrase_collocations": op13_collocations,
}
ORACLES = {
    "op1_pii": oracles.PII,
    "op4_packing": oracles.packing(),
    "op5_secret_scans": oracles.SECRETS,
    "op7_substring_dedup": oracles.SUBSTRINGS,
    "op9_mixing": MIXING_SQL,
    "op10_quality_rules": QUALITY_SQL,
    "op11_merkle_manifest": MERKLE_SQL,
    "op13_phrase_collocations": COLLOCATIONS_SQL,
}
