"""Sources and sinks: test tables, panel builders, CSV ingest, model store."""
