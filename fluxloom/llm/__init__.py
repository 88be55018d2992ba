"""Operators for large-scale training-data pipelines; nothing else in the library imports this subpackage."""

import os

# small matrices on the driver: threads of the linear algebra only wait for each other beside Spark's
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
