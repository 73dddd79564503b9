"""lineflow: control-flow-graph corpora as Spark DataFrames.

Functions, graphs, episodes and traces are DataFrames; every operator is a ``DataFrame ->
DataFrame`` function or a ``Column`` builder, so plans stay visible to Catalyst.
"""

import sys

from pyspark import cloudpickle

# Ship the package's task functions by value: executors then need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
