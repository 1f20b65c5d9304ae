"""kgspark: record linkage, knowledge-graph assembly and graph analytics as Spark DataFrame programs."""
