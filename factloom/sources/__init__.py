"""Sources and sinks: parquet tables with a check of their schema, append, replace by key, JSON documents, snapshots."""
