"""The registered query of each operator and, where SQL can express it, its oracle."""

from __future__ import annotations

from sitelens.llm.bpe import op6_byte_bpe
from sitelens.llm.collocations import OP12_SQL, op12_phrase_collocations
from sitelens.llm.decontaminate import OP9_SQL, op9_benchmark_decontamination
from sitelens.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from sitelens.llm.html_text import op1_html_text
from sitelens.llm.licenses import op5_license_scan
from sitelens.llm.pii import op4_personal_data
from sitelens.llm.sharding import op7_sharding
from sitelens.llm.simhash import op10_simhash_near_dedup
from sitelens.llm.spelling import op13_spelling_variants
from sitelens.llm.token_files import op11_token_files
from sitelens.llm.tool_calls import OP2_SQL, op2_tool_call_linking
from sitelens.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_tool_call_linking": op2_tool_call_linking,
    "op3_toxicity": op3_toxicity,
    "op4_personal_data": op4_personal_data,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_sharding": op7_sharding,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_token_files": op11_token_files,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {
    "op2_tool_call_linking": OP2_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op12_phrase_collocations": OP12_SQL,
}
