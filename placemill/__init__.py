"""Place-intelligence operators on PySpark DataFrames."""
