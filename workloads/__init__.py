"""The library's operators bound to the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark import cloudpickle

import cinelake


def load():
    """All workloads and their SQL.

    Functions that run in Python workers travel with the job, so workers need no copy of these packages.
    """
    import workloads

    for package in (cinelake, workloads):
        cloudpickle.register_pickle_by_value(package)
    from workloads import aggregates, expressions, filters, jobs, joins, maintenance, ordered, streams, vectors  # noqa: F401
    from workloads.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
