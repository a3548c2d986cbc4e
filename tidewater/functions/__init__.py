"""Column functions."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this subpackage travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
