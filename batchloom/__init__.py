"""batchloom: batch-request analytics as PySpark DataFrame operators."""
