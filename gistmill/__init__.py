"""gistmill: preparing and scoring text-summarisation data with PySpark."""

import sys

from pyspark import cloudpickle

# Arrow helpers travel to the executors inside the task, so a cluster needs no
# separate install of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
