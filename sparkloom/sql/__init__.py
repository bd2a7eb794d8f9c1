"""The SQL front end: statements in a PostgreSQL-like dialect, run on Spark SQL."""
