"""newsloom: session-based news recommendation as Spark DataFrame jobs."""

__all__ = ["schema", "session"]
