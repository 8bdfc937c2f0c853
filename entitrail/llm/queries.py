"""The registered queries of the corpus operators and, where SQL expresses them, their SQL."""

from __future__ import annotations

from .ann import op5_ann
from .bpe import op1_byte_bpe
from .langid import op8_language_id
from .packing import op2_packing
from .pii import op3_pii
from .quality import OP4_SQL, op4_quality_rules
from .simhash import op6_simhash
from .simple8b import op10_simple8b
from .toxicity import op7_toxicity
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_quality_rules": op4_quality_rules,
    "op5_ann": op5_ann,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_simple8b": op10_simple8b,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": OP4_SQL,
    "op9_warc": OP9_SQL,
}
