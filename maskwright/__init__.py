"""Span analytics over text on Spark: detect, compare, vote, rewrite and search marked stretches of text."""
