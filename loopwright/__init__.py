"""Loopwright: the data side of prompt-program development, on Spark.

Labelled tables are split, scored and turned into programs; prediction traces
meet user feedback; corrected records go back into the training set.  Every
operator takes DataFrames and returns a DataFrame.
"""

from loopwright.session import checkpoint, configure, new_shared_path, shared_dir
from loopwright.spec import TaskSpec

__all__ = ["TaskSpec", "checkpoint", "configure", "new_shared_path", "shared_dir"]
