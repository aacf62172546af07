"""gripelens: customer-feedback analytics as Spark DataFrame jobs.

Every public operator takes and returns DataFrames.  The sub-packages are
``sources`` (reading, writing, ingest), ``functions`` (column expressions),
``operators`` (joins, aggregations, vector and clustering jobs), ``plans``
(the end-to-end run and the query catalogue) and ``streaming``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
