"""lodeworks: a Spark-first engine for code, audit and corpus analytics."""
