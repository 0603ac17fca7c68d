"""The queries of this subpackage, one for each operator, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe_forced_boundaries
from .embedding_dedup import OP2_SQL, op2_embedding_nn_descent
from .jaccard import OP9_SQL, op9_jaccard_join
from .langid import op5_language_centroids
from .license_scan import op8_license_sentences
from .mixing import op10_mixing_soft_membership
from .pii import op3_pii_weak_supervision
from .quality import op1_quality_bradley_terry
from .secret_scan import op4_secret_forest
from .topk import OP7_SQL, op7_ball_tree_top5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_bradley_terry": op1_quality_bradley_terry,
    "op2_embedding_nn_descent": op2_embedding_nn_descent,
    "op3_pii_weak_supervision": op3_pii_weak_supervision,
    "op4_secret_forest": op4_secret_forest,
    "op5_language_centroids": op5_language_centroids,
    "op6_bpe_forced_boundaries": op6_bpe_forced_boundaries,
    "op7_ball_tree_top5": op7_ball_tree_top5,
    "op8_license_sentences": op8_license_sentences,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_mixing_soft_membership": op10_mixing_soft_membership,
}

#: DuckDB SQL by query name.
ORACLES: dict[str, str] = {
    "op2_embedding_nn_descent": OP2_SQL,
    "op7_ball_tree_top5": OP7_SQL,
    "op9_jaccard_join": OP9_SQL,
}
