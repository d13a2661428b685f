"""Annealed-inference jobs as Spark DataFrames: ladders, weights, evidence, resampling, trees, scores."""
