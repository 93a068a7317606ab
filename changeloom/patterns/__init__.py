"""Matching event sequences (CEP-*)."""

from .match import match_pattern
from .spec import Output, OutputField, PatternSpec, Stage

__all__ = ["Output", "OutputField", "PatternSpec", "Stage", "match_pattern"]
