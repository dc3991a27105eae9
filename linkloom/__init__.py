"""linkloom: entity-link analytics and corpus preparation on PySpark DataFrames."""
