"""Operators for training-data pipelines, each with its registered query.

Every module holds one operator with its own interface, and a query
``opN_<name>(spark, sf_dir)`` that applies it to a whole input table. Functions
that run inside tasks are shipped by value, so that executors need only the
installed libraries and not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
