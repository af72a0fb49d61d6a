"""Coverage-tracked tables on Spark: query, validate, mutate, plan and publish."""

import sys

from pyspark import cloudpickle

# functions used inside tasks travel with the plan, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
