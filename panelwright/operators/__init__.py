"""DataFrame-to-DataFrame operators on panels of time series."""
