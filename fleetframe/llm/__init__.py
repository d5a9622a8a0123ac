"""Operators for building training corpora from documents, pages and vectors.

Nothing outside this folder imports it.  Functions that run in Python
workers are shipped by value, so executors need no copy of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
