"""Recurrent-event cohort analytics as DataFrame-to-DataFrame transformations."""

import sys

from pyspark import cloudpickle

from recurra.config import CohortConfig, Emigration, ModelSpec

# The few functions that run in Python workers travel with their tasks, so the
# workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CohortConfig", "Emigration", "ModelSpec"]
