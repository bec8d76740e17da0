"""All queries and their SQL: importing the modules registers them."""

from __future__ import annotations

from . import adapters, attribution, contexts, evidence, grounding, hybrid, levels, memories, nested, packs, profiles, questions, relations, scores, search, trees, walks  # noqa: F401
from .registry import FLAGSHIP, QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
