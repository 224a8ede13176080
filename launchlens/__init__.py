"""launchlens: order-lifecycle analytics around product launches, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
