"""Critical-care cohort analytics on Spark DataFrames."""
