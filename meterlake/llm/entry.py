"""What the driver's entry module takes from this subpackage, the pipeline included."""

from __future__ import annotations

import importlib.util

from . import queries as registered


def queries() -> dict:
    pipeline = _pipeline()
    return registered.queries() | ({"pipeline": pipeline.run} if pipeline else {})


def oracle_sql() -> dict[str, str]:
    pipeline = _pipeline()
    return registered.oracle_sql() | ({"pipeline": pipeline.ORACLE_SQL} if pipeline and pipeline.ORACLE_SQL else {})


def _pipeline():
    """The pipeline lies at the repository's top; with the package alone on the path there is none. Its own faults are not hidden."""
    if importlib.util.find_spec("corpus_pipeline") is None:
        return None
    import corpus_pipeline

    return corpus_pipeline
