"""Imports every query module so that the registry is complete."""

from cohera.plans import q_core, q_evaluate, q_graph, q_joins, q_models, q_reports, q_splits, q_tables, q_text  # noqa: F401
from cohera.plans.base import QUERIES, SQL  # noqa: F401
