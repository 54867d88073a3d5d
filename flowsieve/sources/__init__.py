"""Reading and writing: raw CSV, Parquet datasets and fitted pipelines."""
