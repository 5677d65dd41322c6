"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import sql
from .line_dedup import op5_line_dedup
from .mixing import op9_mixing
from .order_minhash import op8_order_minhash
from .packing import op7_packing
from .quality_rules import op1_quality_rules
from .secret_scan import op3_secret_scan
from .sharding import op2_sharding
from .simhash import op10_simhash_near_dedup
from .toxicity import op4_toxicity
from .url_rules import op6_url_rules


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_sharding": op2_sharding,
        "op3_secret_scan": op3_secret_scan,
        "op4_toxicity": op4_toxicity,
        "op5_line_dedup": op5_line_dedup,
        "op6_url_rules": op6_url_rules,
        "op7_packing": op7_packing,
        "op8_order_minhash": op8_order_minhash,
        "op9_mixing": op9_mixing,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
    }


def oracles() -> dict[str, str]:
    return sql.ORACLES
