"""The registered queries: each operator on the given tables, with the SQL that checks it where SQL can."""

from textlens.plans import analysis, corpus, graphs, learning, posts, spaces  # noqa: F401
from textlens.plans.registry import PLANS, Plan

__all__ = ["PLANS", "Plan"]
