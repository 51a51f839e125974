"""Queries of the training-data operators, by name."""

from __future__ import annotations

from .bpe import op2_backtracking_bpe
from .iblt import op7_paragraph_sketch
from .langid import op5_language_mixture
from .media import op4_avi_frames
from .packing import op6_best_fit
from .pii import op9_feistel_pseudonyms
from .quality import op8_line_field
from .sharding import op10_byte_shards
from .simhash import op3_simhash
from .token_files import op1_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_backtracking_bpe,
        op3_simhash,
        op4_avi_frames,
        op5_language_mixture,
        op6_best_fit,
        op7_paragraph_sketch,
        op8_line_field,
        op9_feistel_pseudonyms,
        op10_byte_shards,
    )
}

ORACLE_SQL: dict[str, str] = {}
