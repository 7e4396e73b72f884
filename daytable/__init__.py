"""Daily feature tables, moments, regression and matrix products as Spark jobs.

Functions that run inside Spark's Python workers travel with the job (pickled by value), so executors need
only numpy, pyarrow and pandas, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
