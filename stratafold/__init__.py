"""Sample-based analytics over star schemas, expressed as Spark DataFrame jobs."""

from stratafold.spec import JoinPair, PrejoinSpec, QuerySpec, SampleSpec

__all__ = ["JoinPair", "PrejoinSpec", "QuerySpec", "SampleSpec"]
