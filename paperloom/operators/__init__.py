"""Analyses over the normalised tables: one function for each output table, DataFrame in, DataFrame out."""
