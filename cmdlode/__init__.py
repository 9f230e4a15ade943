"""cmdlode: command-log mining on Spark.

Every batch operator takes and returns DataFrames (scalars take and return
Columns) and is built from native expressions, aggregates, joins and windows.
Python runs only inside the keyed streaming state of ``cmdlode.streaming``.
"""

from cmdlode.params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
