"""All queries outside the llm subpackage, with their oracle SQL."""

from __future__ import annotations

from textloom.plans import corpus, evaluation, sequences
from textloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "evaluation", "sequences"]
