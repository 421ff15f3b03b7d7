"""Call analytics on Spark: table-in, table-out operators over calls, turns, frames, transcripts, scores and events."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
