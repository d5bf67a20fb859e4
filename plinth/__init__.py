"""Basket and catalogue analytics on Spark DataFrames."""
