"""Interaction-log preparation, leakage-safe splitting, vector scoring and ranking evaluation on Spark.

Every operator is a function from DataFrames to DataFrames. Column names default to the
canonical ones (``user_id, item_id, timestamp`` in epoch milliseconds) and can be passed in.
"""
