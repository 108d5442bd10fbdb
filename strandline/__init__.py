"""Time-series research on Spark: bars, features, events, exits, metrics and models as DataFrame transformations."""
