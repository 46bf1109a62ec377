"""The queries of the numbered operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op9_bpe
from .decontaminate import OP6_SQL, op6_decontamination
from .html_text import op2_html_extraction
from .line_dedup import OP7_SQL, op7_line_dedup
from .lm_score import op11_lm_score
from .near_dedup import op1_near_dedup
from .periodic import OP12_SQL, op12_periodic_runs
from .quality import op4_quality
from .sharding import op3_sharding
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .token_counts import op5_token_counts
from .toxicity import op10_toxicity
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    f.__name__: f for f in (
        op1_near_dedup, op2_html_extraction, op3_sharding, op4_quality, op5_token_counts, op6_decontamination, op7_line_dedup,
        op8_substring_dedup, op9_bpe, op10_toxicity, op11_lm_score,
        op12_periodic_runs, op13_vector_codes
    )
}
ORACLE_SQL = {"op6_decontamination": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op12_periodic_runs": OP12_SQL, "op13_vector_codes": OP13_SQL}
