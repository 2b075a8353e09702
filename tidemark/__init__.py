"""tidemark: bitemporal facts, identity resolution and count forecasts on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions shipped to tasks carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
