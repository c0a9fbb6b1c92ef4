"""Spark jobs for preparing and evaluating large collections of tokenised samples."""

import sys

from pyspark import cloudpickle

from tesserae.session import get_spark

# Functions sent to workers carry their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark"]
