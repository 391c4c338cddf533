"""Fine-tuning data preparation and evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel to the executors with the job, so the
# package only has to be installed where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
