"""Named queries over the parquet tables and their SQL twins."""
