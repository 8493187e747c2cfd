"""Newton-trained binary logistic regression as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The batch functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
