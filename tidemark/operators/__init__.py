"""Analytics operators: functions from DataFrames to DataFrames."""
