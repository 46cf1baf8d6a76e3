"""Code that Python workers run."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def sent_whole(module: str) -> None:
    """Send what a module defines to workers as it is, so that they needn't have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
