"""Signal evaluation and event memory as Spark DataFrame operators."""
