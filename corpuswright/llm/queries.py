"""The operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from corpuswright.llm.decontaminate import OP5_SQL, op5_query
from corpuswright.llm.fingerprints import op1_query
from corpuswright.llm.html_text import op10_query
from corpuswright.llm.langid import op2_query
from corpuswright.llm.licenses import op9_query
from corpuswright.llm.neardup import op6_query
from corpuswright.llm.packing import op4_query
from corpuswright.llm.substrings import op3_query
from corpuswright.llm.token_store import op8_query
from corpuswright.llm.warc import op7_query

QUERIES = {
    "op1_fingerprints": op1_query,
    "op2_language_id": op2_query,
    "op3_suffix_dedup": op3_query,
    "op4_best_fit_packing": op4_query,
    "op5_decontamination": op5_query,
    "op6_minhash_neardup": op6_query,
    "op7_warc": op7_query,
    "op8_token_store": op8_query,
    "op9_licenses": op9_query,
    "op10_html_text": op10_query,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": OP5_SQL,
}
