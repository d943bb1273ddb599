"""viatrix: transport-appraisal analytics and training-data preparation as PySpark plans.

Functions of this package that run on executors travel with the task (pickled by value), so
executors need only PySpark's own Python, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
