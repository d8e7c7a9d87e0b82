"""Private-telemetry analytics on Spark."""
