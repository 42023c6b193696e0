"""Language-identification analytics as Spark DataFrame operators."""
