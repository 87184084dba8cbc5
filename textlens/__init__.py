"""textlens: studying topics in very large archives of short messages with PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Tasks carry the functions they run, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
