"""evistrata: literature-evidence analytics as PySpark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing in the package runs an action unless its docstring says so.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
