"""answerlake: a semantic answer cache as Spark table and stream jobs."""
