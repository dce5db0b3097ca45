"""lattica: a PySpark-native analytics engine for annotated observation-by-feature data."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
