"""textloom: text normalization, corpus mining and dictionary analytics as Spark jobs."""
