"""Training-data operators.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors may have no copy of this package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
