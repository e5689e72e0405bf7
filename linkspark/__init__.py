"""Record matching, linking and deduplication on PySpark DataFrames."""
