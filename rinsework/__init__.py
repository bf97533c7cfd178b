"""rinsework: data profiling, repair and auditing as lazy Spark plans."""

__version__ = "0.1.0"
