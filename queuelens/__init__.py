"""Queue and message-log analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Handlers and state processors travel to the workers with their code, so the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
