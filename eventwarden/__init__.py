"""Security event analytics as plain Spark jobs: ``DataFrame -> DataFrame``."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel with the job: the workers need numpy,
# pandas and Arrow, but no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
