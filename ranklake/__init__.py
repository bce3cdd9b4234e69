"""ranklake: ranked full-text retrieval, metadata enrichment and chat-context
assembly expressed as Spark DataFrame jobs over tables of requests."""

from ranklake.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
