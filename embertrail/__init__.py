"""Log triage on Spark: ingest, clustering, anomalies, regressions, incidents and reports as DataFrame plans."""

import sys

from pyspark import cloudpickle

from embertrail.session import build_session, durable

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "durable"]
