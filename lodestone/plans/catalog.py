"""Registered queries of the library's core, and the SQL they are compared with."""

from __future__ import annotations

from lodestone.operators import flatten

from . import evaluation, evidence, graphs, parsing, proofs, retrieval

_PARTS = (retrieval, graphs, evaluation, evidence, proofs, parsing)
QUERIES: dict = {k: v for m in (*_PARTS, flatten) for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _PARTS for k, v in m.ORACLES.items() if k in QUERIES}
