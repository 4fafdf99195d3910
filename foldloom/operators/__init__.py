"""Preparation, graphs, folds, metrics, rollups, statistics and models, as functions of DataFrames."""
