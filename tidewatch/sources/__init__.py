"""Sources: driver tables, domain views over them, CSV ingest and sinks."""
