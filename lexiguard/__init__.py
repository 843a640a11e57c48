"""lexiguard: text-risk analytics and corpus preparation on PySpark.

Worker functions are shipped to executors by value, so a cluster needs no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
