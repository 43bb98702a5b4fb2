"""Scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPONENTS = ["lexical_score", "metadata_score", "locator_score", "type_modality_score", "graph_prior_score"]
#: Weight presets, in the order of COMPONENTS.
PRESETS = {
    "lexical_only": (1.0, 0.0, 0.0, 0.0, 0.0),
    "lexical_metadata": (1.0, 0.50, 0.0, 0.25, 0.0),
    "lexical_locator": (1.0, 0.0, 0.50, 0.0, 0.0),
    "lexical_graph": (1.0, 0.0, 0.0, 0.0, 0.50),
    "full_hybrid": (1.0, 0.50, 0.25, 0.25, 0.25),
    "hybrid_no_graph": (1.0, 0.50, 0.25, 0.25, 0.0),
    "graph_only_prior": (0.0, 0.0, 0.0, 0.0, 1.0),
}
K1, B = 1.5, 0.75


def bm25_term(qtf: Column, tf: Column, df: Column, n: Column, length: Column, mean_length: Column) -> Column:
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    mean = F.when(mean_length == 0, F.lit(1.0)).otherwise(mean_length)
    return qtf * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def overlap(query: Column, candidate: Column) -> Column:
    """Share of distinct query tokens that the candidate has; 0 without query tokens."""
    n = F.size(F.array_distinct(query))
    return F.when(n > 0, F.size(F.array_intersect(query, candidate)) / n).otherwise(F.lit(0.0))


def hybrid(preset: str = "full_hybrid") -> Column:
    return sum((F.col(c) * w for c, w in zip(COMPONENTS, PRESETS[preset], strict=True)), F.lit(0.0))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d <= 0, F.when(n > 0, 1.0).otherwise(0.0)).otherwise(n / d)
