"""Where catalogs come from: Parquet folders, the session, databases, declared models and snapshots."""
