"""Registered queries with their SQL counterparts."""

from gradeloom.catalog import evaluation, filling, fits, models, profiling, similarity, text  # noqa: F401
from gradeloom.catalog.registry import INVENTORY, ORACLES, QUERIES  # noqa: F401
