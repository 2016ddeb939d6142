"""Table-in, table-out operators (DataFrame -> DataFrame)."""
