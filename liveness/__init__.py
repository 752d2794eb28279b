"""liveness: code-liveness analytics as Spark jobs.

Functions of this package that run inside tasks (the Arrow extraction pass) are
pickled by value, so executors need no installed copy of the package: the job
carries its code."""

import sys as _sys

try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):
    pass
