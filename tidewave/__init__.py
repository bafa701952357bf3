"""tidewave: search, matching and cleaning of numeric time series as Spark jobs."""

__version__ = "0.1.0"
