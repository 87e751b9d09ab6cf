"""tidemark: trace adjudication and data-pipeline operators on Spark."""
