"""Story-corpus analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run inside Python tasks travel with the job, so that
# executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
