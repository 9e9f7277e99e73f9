"""Detection analytics as composable Spark DataFrame operators."""
