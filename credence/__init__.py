"""credence: document-validation analytics as plain Spark DataFrame operators."""
