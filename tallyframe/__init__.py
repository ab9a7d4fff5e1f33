"""Mainframe record analytics on Spark: codecs, picture arithmetic, record sources,
COBOL row programs, positional verification and portfolio analytics as DataFrames."""
