"""Training-data operators. Nothing else in the package imports this subpackage."""

import importlib
import sys

from pyspark import cloudpickle

#: Kernels run in Python workers that may not have this repository on their path, so they travel by value.
_SHIPPED = ("textkernel", "golay", "langid", "decontam", "iblt", "pii", "repeats", "simhash", "toxicity")
for _name in _SHIPPED:
    importlib.import_module(f"{__name__}.{_name}")
    cloudpickle.register_pickle_by_value(sys.modules[f"{__name__}.{_name}"])
