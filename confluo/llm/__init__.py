"""Training-data operators: deduplication, filtering, decontamination and token work.

Nothing outside this subpackage imports it.  Functions that run in Python
workers are shipped by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
