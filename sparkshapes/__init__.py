"""sparkshapes: reasoning over RDF graphs and SHACL validation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get this package's functions with the tasks, so they need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
