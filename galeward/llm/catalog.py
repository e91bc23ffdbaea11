"""The text operators' queries, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .exact_dedup import OP9_SQL, op9_exact_dedup
from .line_dedup import op2_line_dedup
from .lm_scoring import op6_lm_scoring
from .mixing import OP5_SQL, op5_mixing
from .packing import op3_packing
from .pii import op1_pii
from .quality import op10_quality
from .simhash import op7_simhash
from .substring_dedup import op8_substring_dedup
from .toxicity import op4_toxicity


def queries() -> dict:
    return {"op1_pii": op1_pii, "op2_line_dedup": op2_line_dedup, "op3_packing": op3_packing, "op4_toxicity": op4_toxicity, "op5_mixing": op5_mixing, "op6_lm_scoring": op6_lm_scoring, "op7_simhash": op7_simhash, "op8_substring_dedup": op8_substring_dedup, "op9_exact_dedup": op9_exact_dedup, "op10_quality": op10_quality}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5_SQL, "op9_exact_dedup": OP9_SQL}
