"""Queries of this subpackage and the DuckDB statements they are checked against."""

from __future__ import annotations

from . import oracles
from .bpe import op7_byte_bpe
from .chat import op10_chat_quotations
from .decontaminate import op6_decontamination
from .lines import op4_line_dedup
from .minhash import op1_minhash_near_dedup
from .neighbours import op3_nearest_neighbours
from .quality import op5_quality
from .substring import op2_substring_dedup
from .toxicity import op8_toxicity
from .warc import op9_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_substring_dedup, op3_nearest_neighbours, op4_line_dedup, op5_quality,
        op6_decontamination, op7_byte_bpe, op8_toxicity, op9_warc, op10_chat_quotations,
    )
}
#: The others are held against brute force, the tokenizer library or held-out labels in the tests.
ORACLES = {
    "op1_minhash_near_dedup": oracles.OP1,
    "op2_substring_dedup": oracles.OP2,
    "op9_warc": oracles.OP9,
    "op10_chat_quotations": oracles.OP10,
}
