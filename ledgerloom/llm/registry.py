"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from .bpe import op10_bpe
from .centroids import OP12_SQL, op12_centroids
from .decontaminate import OP5_SQL, op5_decontaminate
from .html import op1_extract
from .near_dedup import OP9_SQL, op9_near_dedup
from .pii import op8_pii
from .phrases import OP11_SQL, op11_phrases
from .piece_bpe import op13_pieces
from .quality import op4_quality
from .secrets import op7_secrets
from .sharding import op6_sharding
from .substrings import OP3_SQL, op3_substrings
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_extract": op1_extract,
    "op2_warc": op2_warc,
    "op3_substrings": op3_substrings,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_sharding": op6_sharding,
    "op7_secrets": op7_secrets,
    "op8_pii": op8_pii,
    "op9_near_dedup": op9_near_dedup,
    "op10_bpe": op10_bpe,
    "op11_phrases": op11_phrases,
    "op12_centroids": op12_centroids,
    "op13_pieces": op13_pieces,
}
ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op3_substrings": OP3_SQL, "op5_decontaminate": OP5_SQL, "op9_near_dedup": OP9_SQL, "op11_phrases": OP11_SQL, "op12_centroids": OP12_SQL}
