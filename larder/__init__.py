"""larder: household nutrition analytics as composable Spark DataFrame operators."""
