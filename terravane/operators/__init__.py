"""Vector-geometry operators, DataFrame in and DataFrame out."""
