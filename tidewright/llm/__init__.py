"""Operators for training-data pipelines: deduplication, quality, mixing, formatting, encoding, search.

Nothing outside this package imports it. Every module states what it does with nulls, empty tables,
ties, repeated rows and long texts.

Functions that run in tasks are sent by value, so executors need the third-party libraries alone and not
this package on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
