"""The queries of this package, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from tidemark.llm.decontamination import OP2_SQL, op2_decontamination
from tidemark.llm.embedding_dedup import op7_embedding_dedup
from tidemark.llm.html_text import op8_html_extraction
from tidemark.llm.language_id import op3_language_id
from tidemark.llm.license_scan import op6_license_scan
from tidemark.llm.minhash_dedup import op1_minhash_dedup
from tidemark.llm.mixing import op5_mixing
from tidemark.llm.oracle_sql import OP1_SQL, OP4_SQL, OP7_SQL
from tidemark.llm.personal_data import op10_personal_data
from tidemark.llm.quality_rules import OP12_SQL, op12_quality_rules
from tidemark.llm.secrets import op9_secret_scan
from tidemark.llm.spelling_variants import OP11_SQL, op11_spelling_variants
from tidemark.llm.substring_dedup import op4_substring_dedup
from tidemark.llm.token_alignment import op13_token_alignment


def registry() -> dict:
    found = [op1_minhash_dedup, op2_decontamination, op3_language_id, op4_substring_dedup, op5_mixing, op6_license_scan, op7_embedding_dedup, op8_html_extraction, op9_secret_scan, op10_personal_data,
             op11_spelling_variants, op12_quality_rules, op13_token_alignment]
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op4_substring_dedup": OP4_SQL,
            "op7_embedding_dedup": OP7_SQL, "op11_spelling_variants": OP11_SQL,
            "op12_quality_rules": OP12_SQL}
