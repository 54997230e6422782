"""evalgrid: evaluation analytics on Spark.

Responses and answer keys come in as tables, deterministic rules grade them
into pass/fail rows, and those rows become weighted scores, intervals, paired
tests, boards, gates and audits. Every public function takes DataFrames or
Columns and returns them; Spark plans and runs the work.
"""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# The few functions that run in Python tasks travel with them, so that the
# executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])

#: The three dimensions of a score, in report order (fixed values).
DIMENSIONS = ("restraint", "honesty", "conviction")
