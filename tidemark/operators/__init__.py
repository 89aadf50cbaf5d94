"""Time-series operators over long panel tables."""
