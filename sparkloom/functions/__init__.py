"""Scalar functions of the dialect, as Spark expressions, with operators that show them on the test tables."""
