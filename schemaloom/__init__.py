"""schemaloom: catalog comparison and migration planning as Spark jobs."""
