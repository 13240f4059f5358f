"""Content admission, scan analytics and corpus preparation on PySpark."""
