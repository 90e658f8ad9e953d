"""tracefold: a Spark-first engine for incident context over operational telemetry."""
