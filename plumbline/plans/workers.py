"""Python kernels travel to the executors with the job.

A cluster need not have this package installed: the few functions that run in
Python workers are pickled by value.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
