"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op7_decontaminate
from .lattice import op9_lattice_score
from .mil import op4_quality
from .line_dedup import OP8_SQL, op8_line_dedup
from .ngram_join import OP6_SQL, op6_ngram_join
from .ogg import op5_media
from .packing import op3_packing
from .substring_dedup import op2_substring_dedup
from .token_counts import op10_token_counts
from .wrappers import op1_html_text

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_media": op5_media,
    "op6_ngram_join": op6_ngram_join,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_dedup": op8_line_dedup,
    "op9_lattice_score": op9_lattice_score,
    "op10_token_counts": op10_token_counts,
}
ORACLES: dict[str, str] = {"op6_ngram_join": OP6_SQL, "op8_line_dedup": OP8_SQL}
