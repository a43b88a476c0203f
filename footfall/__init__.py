"""Website-traffic analytics as Spark jobs: ingest, score, roll up and query."""
