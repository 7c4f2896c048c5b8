"""faultframe: sensor-recording analytics as lazy Spark DataFrame, MLlib and Structured Streaming jobs."""
