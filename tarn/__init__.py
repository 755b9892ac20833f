"""tarn: Spark-first analytics for annual site observations."""
