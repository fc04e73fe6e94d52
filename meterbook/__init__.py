"""Token-usage ledger analytics on PySpark DataFrames."""
