"""callgrove: build, check and score tool-calling datasets with PySpark."""
