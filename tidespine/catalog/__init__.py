"""All registered queries. Importing a module registers its entries."""
from tidespine.catalog.base import ORACLE, QUERIES
from tidespine.catalog import q_features, q_models, q_operators, q_sources, q_stream  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
