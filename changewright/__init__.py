"""Schema-change history, data prechecks, column changes, backfills and SQL audit as Spark jobs."""
