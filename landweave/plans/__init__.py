"""Named queries: each takes (spark, dir) and returns a DataFrame."""
