"""logweft: log files as Spark tables and streams.

Every public operator takes a DataFrame and returns a DataFrame, so they
chain with ``df.transform(...)`` and run the same on a batch table and on a
Structured Streaming source wherever the operator is stateless.
"""

import sys as _sys

try:  # Ship the library's UDFs and data sources by value: executors need no install.
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

from logweft.session import configure, get_session, shared_dir  # noqa: E402
from logweft.schema import LOG_SCHEMA  # noqa: E402

__all__ = ["configure", "get_session", "shared_dir", "LOG_SCHEMA"]
