"""synthscore — Spark-native evaluation of synthetic tabular data and analysis of trial logs.

Every public operator is a pure function DataFrame -> DataFrame (no global session).
Sub-packages:

* ``sources``   readers, fixtures and sinks (inventory A, B)
* ``functions`` column-expression helpers (scalar rules such as clip01)
* ``operators`` relational operators grouped by domain (C .. N)
* ``plans``     the registered queries with their DuckDB oracle SQL
* ``streaming`` Structured Streaming status queries (S)
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: workers need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
