"""Spark jobs over collections of multichannel recordings and over text corpora."""
