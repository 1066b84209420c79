"""All registered queries and their SQL, but for those of the llm subpackage."""

from __future__ import annotations

from millrace.plans import localise_queries, training_queries, uncertainty_queries, calibration_queries, code_queries, dataset_queries, drift_queries, evaluation_queries, graph_queries, report_queries, retrieval_queries, stream_queries

MODULES = (drift_queries, retrieval_queries, evaluation_queries, dataset_queries, graph_queries, calibration_queries, stream_queries, code_queries, localise_queries, uncertainty_queries, training_queries, report_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
