"""Corpus preparation for language models, as Spark DataFrame operators.

Functions of this package travel to executors by value, so that executors need
its dependencies but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
