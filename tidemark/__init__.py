"""Folder reconciliation as Spark plans."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel with their code: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
