"""Column functions: cells, measures, texts, classes."""
