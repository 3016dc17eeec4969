"""Training-data pipeline operators.

Everything here is self-contained: no other module of the library imports it.
Functions of this subpackage are pickled by value, so executors need no copy
of the repository on their Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
