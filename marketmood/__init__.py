"""marketmood: PySpark-native sentiment and price-feature analytics.

Every public function takes and returns Spark DataFrames (or Columns) and
builds one lazy plan; nothing is collected to the driver inside an operator.
"""

from marketmood.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
