"""Spans of private data in text: found, judged, redacted, recorded and replayed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
