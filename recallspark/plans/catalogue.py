"""Every query of the core and its SQL twin."""

from recallspark.plans import cognition, ingest, knowledge, parsed, retrieval, scale, streams

FLAGSHIP = "recall_hybrid"
_MODULES = [scale, ingest, parsed, knowledge, retrieval, cognition, streams]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
