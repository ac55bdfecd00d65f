"""The registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from .byte_bpe import op4_byte_bpe
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .katz import OP3_SQL, op3_katz_backoff
from .label_shards import op10_label_shards
from .language_id import op9_language_id
from .media import op1_webp_media
from .mixing import OP2_SQL, op2_poisson_mix
from .ngram_join import OP7_SQL, op7_ngram_jaccard
from .repeats import OP6_SQL, op6_repeated_substrings
from .toxicity import op5_toxicity

QUERIES = {
    "op1_webp_media": op1_webp_media,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_katz_backoff": op3_katz_backoff,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_repeated_substrings": op6_repeated_substrings,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_label_shards": op10_label_shards,
}

ORACLE_SQL = {
    "op2_poisson_mix": OP2_SQL,
    "op3_katz_backoff": OP3_SQL,
    "op6_repeated_substrings": OP6_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
}
