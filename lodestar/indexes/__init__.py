"""Secondary indexes as Parquet tables that a scan can prune."""
