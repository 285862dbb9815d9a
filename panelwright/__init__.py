"""Panel analytics for financial and macroeconomic time series, written as Spark DataFrame plans.

Every public function takes and returns DataFrames. Most run nothing by themselves; those that start Spark jobs are the
model fits in ``operators.predictor`` and ``operators.walkforward``, the row numbering in ``operators.segments``, the
snapshot writer in ``sources.snapshots`` and the refresh in ``plans.refresh``.
"""

import sys

from pyspark import cloudpickle

# Functions sent to the executors travel with the plan, so the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
