"""Scores of point, interval and class-probability forecasts, and conformity scores."""
