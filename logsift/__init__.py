"""Log triage on Spark: labelling, batching, verdict reuse and evaluation."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Tasks carry the library code they use, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
