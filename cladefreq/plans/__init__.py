"""Whole analyses: the reports over real inputs, and the queries over the star tables."""
