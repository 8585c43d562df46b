"""Sources (CSV, JSON, archives, JDBC, SQL over registered views), sinks and ingest checks."""
