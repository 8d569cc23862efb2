"""Importing this module registers every query."""

from codestrata.plans import architecture, commit_graph, decisions, detection, evolution, parsing, record_check, reports, review, snapshots, structure, views  # noqa: F401
from codestrata.plans.registry import ORACLES, QUERIES  # noqa: F401
