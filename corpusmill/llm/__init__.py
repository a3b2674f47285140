"""Operators for preparing training data: DataFrame in, DataFrame out."""
