"""strandline: short-read sequencing analytics as Spark DataFrames.

Reads, alignments and depth intervals are rows.  Every operator is a plain
function ``DataFrame -> DataFrame`` usable with ``DataFrame.transform``; Spark
plans, shuffles and spills the work.
"""

import sys

from pyspark import cloudpickle

# The few Arrow functions of this package travel to the executors by value, so
# a job needs no --py-files for them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
