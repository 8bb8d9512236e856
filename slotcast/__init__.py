"""Forecasting a fine-grained series from coarser covariates, on Spark DataFrames."""
