"""Training-data operators: ten document-scale tools that the rest of the library never imports.

Their functions travel to executors by value, so a cluster needs numpy, pyarrow and the public
libraries an operator names, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
