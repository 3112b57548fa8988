"""The subpackage's queries, by name, and their SQL where SQL can express them. The others are tested by brute force in tests/llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaystone.llm import centroids, jaccard, resampling
from quaystone.llm.centroids import op11_centroids
from quaystone.llm.chunk_reuse import op8_bpe
from quaystone.llm.fingerprints import op12_fingerprints
from quaystone.llm.jaccard import op10_jaccard
from quaystone.llm.language_id import op5_language_id
from quaystone.llm.licenses import op2_licenses
from quaystone.llm.lm_scoring import op6_lm_scoring
from quaystone.llm.neighbours import op4_nearest
from quaystone.llm.packing import op1_packing
from quaystone.llm.prefix_counts import op3_token_counts
from quaystone.llm.quality import op9_quality
from quaystone.llm.resampling import op13_resampling
from quaystone.llm.token_files import op7_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_licenses": op2_licenses,
        "op3_token_counts": op3_token_counts,
        "op4_nearest": op4_nearest,
        "op5_language_id": op5_language_id,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_token_files": op7_token_files,
        "op8_bpe": op8_bpe,
        "op9_quality": op9_quality,
        "op10_jaccard": op10_jaccard,
        "op11_centroids": op11_centroids,
        "op12_fingerprints": op12_fingerprints,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_jaccard": jaccard.SQL, "op11_centroids": centroids.SQL, "op13_resampling": resampling.SQL}
