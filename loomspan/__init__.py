"""loomspan: code-graph analytics and generic graph, interval and name-resolution operators on PySpark."""
