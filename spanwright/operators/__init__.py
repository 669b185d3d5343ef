"""Relational operators: DataFrame in, DataFrame out, key columns as arguments."""
