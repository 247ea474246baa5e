from supplyscope.sources.tables import LazyTables, catalog_tables, parquet_tables  # noqa: F401
