"""salescope: sales-analytics operators for Spark.

Every operator takes a DataFrame (plus column names) and returns a DataFrame.
Nothing is collected to the driver; results stay lazy until the caller acts.

Packages:
  functions  column expressions (cleaning, formats, guarded ratios, hashing)
  sources    CSV/Parquet/JSON/binaryFile readers and writers, fixture view, landing
  operators  KPIs, grid ops, time series, facts, vector and text search, text assembly
  plans      composed results (analysis, root cause, forecast, report) and registered queries
  streaming  Structured Streaming versions of file landing and feedback intake
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from salescope.session import build_session, checkpoint_root

# Ship this package's functions to Python workers by value, so executors need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["build_session", "checkpoint_root"]
