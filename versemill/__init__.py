"""Verse-grained text corpus engine on Spark DataFrames."""
