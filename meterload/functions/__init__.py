"""Column expressions: time, calendar features, row statistics, array arithmetic."""
