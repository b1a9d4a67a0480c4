"""textloom: text-corpus and tokenizer analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
