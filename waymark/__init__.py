"""Geographic recovery and validation of large record tables, as Spark DataFrame operators."""
