"""vectorloom: dataset preparation, vector retrieval and ranking evaluation as Spark DataFrame operators."""
