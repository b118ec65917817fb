"""boardloom: Spark-first operators over circuit-board tables and the texts around them."""
