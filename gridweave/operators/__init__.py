"""Operators on tables of points, frames, windows and forecasts."""
