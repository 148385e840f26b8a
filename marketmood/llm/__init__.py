"""Training-data operators (one module per operator) and their registered queries.

Functions of this package that run inside tasks are shipped with the task, so
executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
