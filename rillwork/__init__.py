"""A PySpark-native engine for typed data pipelines."""


def version() -> str:
    """The version of the engine that does the work."""
    import pyspark

    return pyspark.__version__
