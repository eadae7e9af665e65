"""Privacy-safe page and document analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python workers' functions travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
