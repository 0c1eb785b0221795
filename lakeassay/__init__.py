"""lakeassay: Spark-native integrity analytics for training data.

Every operator takes and returns DataFrames.  Nothing here starts a session;
the caller owns it.
"""

__version__ = "0.1.0"
