"""Registered queries (one per operator of the inventory) and their DuckDB
oracles. Keys start with the inventory id (``c1_…``).

Every query reads the given tables (through the fixtures) and returns flat
scalar columns; floats are rounded to 6 digits on both sides so float noise
from summation order cannot change the value hash.
"""

from __future__ import annotations

# import order matters: later modules use fixtures registered by earlier ones
from kestrel.plans import q_retrieval, q_calibration, q_rerank, q_text, q_datasets, q_models, q_io, q_streaming  # noqa: F401,I001
from kestrel.plans.registry import ORACLES, QUERIES  # noqa: F401
