"""A PySpark library that analyses public API graphs of software packages at scale."""
