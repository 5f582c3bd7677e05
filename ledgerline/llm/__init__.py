"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from pyspark import cloudpickle

import ledgerline.llm as _package

# Functions of this package travel to the executors with the job, so that a cluster needs
# no installed copy of it.
cloudpickle.register_pickle_by_value(_package)
