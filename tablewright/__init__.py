"""tablewright: reading, profiling, cleaning, validating and anonymising tables with PySpark.

Every operator takes and returns DataFrames, so plans stay lazy and Catalyst
sees the whole query.  The few eager steps are named in the operator's
docstring and only ever bring bounded results to the driver.
"""
