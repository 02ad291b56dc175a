"""Scores of speech transcripts and preparation of text, on Spark.

The names below are what a scoring run needs; they are loaded when they are first used.
"""

from __future__ import annotations

from importlib import import_module
from typing import Any

_HOMES = {
    "vaktavya.functions.normalize": ("normalize",),
    "vaktavya.sources.speech": ("LANGUAGES", "align", "load_predictions", "load_release", "supported_rows"),
    "vaktavya.operators.scoring": ("bootstrap_ci", "paired_delta_ci", "row_counts", "score", "score_by", "score_sets"),
    "vaktavya.semantic.pipeline": ("evaluate",),
    "vaktavya.plans.session": ("local_session",),
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str) -> Any:
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)
