"""Quarry: analytics and retrieval over collections of long structured reports, written as Spark plans."""
