"""trendspark — search-trend news analytics as Spark DataFrame jobs.

Sub-packages:
  functions/  Column -> Column expressions (parsing, cleaning, formatting)
  sources/    readers: feed XML, landed tables, literal dimensions
  operators/  DataFrame jobs: ingest, prompts, media, publish, translate, reports
  plans/      query catalog used by the driver contract and the benchmark
  streaming/  Structured Streaming wrappers around the batch jobs
"""

from trendspark.params import Params

__all__ = ["Params"]
