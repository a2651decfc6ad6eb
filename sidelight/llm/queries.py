"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from sidelight.llm.bpe import op4_bpe
from sidelight.llm.chunk_dedup import op3_chunk_dedup
from sidelight.llm.langid import op9_langid
from sidelight.llm.line_dedup import OP10_SQL, op10_line_dedup
from sidelight.llm.minhash import OP1_SQL, op1_minhash
from sidelight.llm.mixing import OP5_SQL, op5_mixing
from sidelight.llm.pivot_index import OP6_SQL, op6_pivot_index
from sidelight.llm.spotsigs import op8_spotsigs
from sidelight.llm.token_files import op2_token_files
from sidelight.llm.url_rules import op7_url_rules

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_token_files": op2_token_files,
    "op3_chunk_dedup": op3_chunk_dedup,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_pivot_index": op6_pivot_index,
    "op7_url_rules": op7_url_rules,
    "op8_spotsigs": op8_spotsigs,
    "op9_langid": op9_langid,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES = {
    "op6_pivot_index": OP6_SQL,
    "op1_minhash": OP1_SQL,
    "op5_mixing": OP5_SQL,
    "op10_line_dedup": OP10_SQL,
}
