"""Operators of a training-data pipeline over tables of documents and pages.

Each module holds one operator and the registered query that applies it with
production parameters; :mod:`tessera.llm.registry` collects the queries.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
