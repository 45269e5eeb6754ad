"""assayer: data-preparation and fitness checks for tables, as Spark jobs."""
