"""DataFrame-in, DataFrame-out operators on panels, series and predictions."""
