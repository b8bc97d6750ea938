"""gridweave: training datasets and forecast evaluation for sensor time series, on Spark."""
