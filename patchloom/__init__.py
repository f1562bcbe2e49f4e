"""patchloom: code-change risk and review analytics as Spark DataFrame jobs."""
