"""Sources and sinks of point series, registries, frames and forecasts."""
