"""Reading and writing tables, file inventories, Parquet footers, markup tables."""
