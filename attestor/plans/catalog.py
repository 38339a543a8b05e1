"""All registered queries."""

from attestor.plans import q_calibration, q_corroboration, q_intake, q_language, q_linking, q_names, q_positions, q_readers, q_relations, q_statements, q_stories, q_streams, q_text, q_windows  # noqa: F401
from attestor.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
