"""foldline: Spark-native data audit, fold-safe feature statistics and model evaluation.

Every operator takes and returns Spark DataFrames (or Columns) so that Catalyst plans
the whole job; Python runs only inside Arrow-batched pandas functions where Spark has
no built-in equivalent (tree building, waveform decoding, per-series recursion).
"""

from foldline.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
