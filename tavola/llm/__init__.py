"""Training-data operators: token counts, token files, vector search, personal
data, line and document near-duplicates, mixing, toxicity and piece encoding.

Nothing else in the library imports this subpackage.
"""

from pyspark import cloudpickle

import tavola

# Python functions travel to the executors with their code, so that the package
# need not be installed there.
cloudpickle.register_pickle_by_value(tavola)
