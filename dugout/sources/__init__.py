"""Where tables come from and go to: driver tables, CSV, Parquet snapshots, lookups."""
