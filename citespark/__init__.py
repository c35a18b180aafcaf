"""Citation recommendation and paper-library analytics as Spark jobs.

``functions``  column expressions (text, scores, identifiers, formatting)
``operators``  DataFrame -> DataFrame building blocks (joins, windows, snapshots)
``sources``    readers and writers (files, library items, feeds, exports)
``plans``      end-to-end jobs (suggest, ingest, library sync)
``streaming``  the same work on Structured Streaming
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel whole: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
