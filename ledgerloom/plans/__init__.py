"""Bindings of the operators to the test tables."""
from .registry import BINDINGS, add_sliced, runner
from . import q_rows, q_stats, q_scores, q_models  # noqa: F401  (they register themselves)

add_sliced()

__all__ = ["BINDINGS", "runner"]
