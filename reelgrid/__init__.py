"""reelgrid: analytics over media archives and text corpora, written for Spark's DataFrame API."""
