"""Scalar functions as column expressions; none of them leaves the JVM."""
