"""Training-data operators: packing, quality rules, fingerprints, LM scoring, joins, PII and more.

Nothing outside this subpackage imports it. Queries are in :mod:`lodestar.llm.queries`.
"""
