"""Session-evidence analytics for Spark: typed events, rollups, search, sequences and graphs as DataFrames."""
