"""Signal, event and group-statistics analytics on DataFrames."""
