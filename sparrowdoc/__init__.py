"""Document retrieval, grading and evaluation as plain Spark DataFrame plans."""

from .session import get_session, read_table, table_path

__all__ = ["get_session", "read_table", "table_path"]

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Workers get this package's functions by value: no copy has to stand on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
