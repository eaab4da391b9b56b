"""Analytics over ordered event logs, on Spark."""
