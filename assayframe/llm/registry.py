"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from assayframe.llm.bytesuffix import op12_suffix_dedup
from assayframe.llm.decontam import OP3_SQL, op3_decontaminate
from assayframe.llm.infill import OP11_SQL, op11_fill_in_middle
from assayframe.llm.langid import op10_language_id
from assayframe.llm.linedup import OP8_SQL, op8_line_dedup
from assayframe.llm.mixing import op2_mix_sources
from assayframe.llm.neardup import op4_near_dedup
from assayframe.llm.prefixtrie import OP13_SQL, op13_prefix_trie
from assayframe.llm.quality import op5_quality_rules
from assayframe.llm.secretscan import op7_secret_scan
from assayframe.llm.substrings import op9_substring_dedup
from assayframe.llm.tokens import op6_token_binary
from assayframe.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_binary": op6_token_binary,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
