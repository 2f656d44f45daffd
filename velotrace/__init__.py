"""Trajectory, street-network and sensor analytics on Spark DataFrames."""
