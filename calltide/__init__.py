"""calltide: Spark-first operators for code-security and call-graph analytics."""
