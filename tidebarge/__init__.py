"""tidebarge: table movement and change tracking expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with the job: workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
