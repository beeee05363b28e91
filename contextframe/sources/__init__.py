"""Sources: parquet tables, file trees, captured git text, configuration files."""
