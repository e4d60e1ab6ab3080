"""Named queries of the training-data operators and the SQL that must give the same rows."""

from __future__ import annotations

import corpus_pipeline
from precinct.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}

ORACLES = {**queries.ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
