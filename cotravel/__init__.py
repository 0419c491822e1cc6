"""Co-movement analytics over large trajectory tables, on Spark SQL."""
