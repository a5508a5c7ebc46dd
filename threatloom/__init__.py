"""Security-event analytics as Spark DataFrame operators."""
