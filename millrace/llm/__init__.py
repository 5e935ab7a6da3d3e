"""Operators of a training-data pipeline on documents and embeddings.

Nothing else in the library imports this package. Functions that run in Python workers are sent
with their code, so that workers need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["millrace"])
