"""Column functions: calendar, seasonality, statistics, metrics, labels."""
