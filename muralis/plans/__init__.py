"""Role projections of the driver tables, the query catalogue and its DuckDB twins."""
