"""Exploratory data analysis on Spark: catalogue, recipes and operators over DataFrames of any size."""
