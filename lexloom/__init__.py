"""lexloom: Spark-native analysis of structured documents.

Every operator takes and returns DataFrames (or Columns), so pipelines are
declared as plans and left to Catalyst.
"""

from lexloom.session import build_session, checkpoint_dir, ship, spread

__all__ = ["build_session", "checkpoint_dir", "ship", "spread"]
