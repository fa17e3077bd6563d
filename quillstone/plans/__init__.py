"""All core queries; importing a module registers its queries."""

from quillstone.plans import evaluation, maintenance, records, relational, retrieval, text, vectors  # noqa: F401
from quillstone.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
