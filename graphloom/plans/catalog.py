"""All queries of the core and their SQL."""

from __future__ import annotations

from graphloom.plans import answers, code_graph, corpus, delivery, pages, questions, retrieval, shells, traversals

_MODULES = (delivery, traversals, code_graph, corpus, pages, questions, retrieval, shells, answers)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
