"""Structured Streaming forms of the stateless scans."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.background import Background
from ..operators.motif import Motif
from ..operators.score import best_scores, scored_strands


def scan_stream(seqs: DataFrame, motifs: list[Motif], bg: Background, least: float = 0.0) -> DataFrame:
    """Best windows of a stream of (seq_id, seq) with a score above ``least``: a map with broadcast models, no state."""
    return best_scores(scored_strands(seqs), motifs, bg).where(f"score > {float(least)}")
