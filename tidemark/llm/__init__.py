"""Operators for large training corpora; nothing outside this folder imports them.

Functions of this package travel to the tasks by value, so that executors need not have it installed. They refer to each
other by imported names, not through modules.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
