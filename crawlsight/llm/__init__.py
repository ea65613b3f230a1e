"""Training-data operators.

Their functions travel with the tasks, so executors need no installed package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
