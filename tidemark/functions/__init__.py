"""Analytics of series as aggregates and windows."""
