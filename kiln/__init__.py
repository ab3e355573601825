"""kiln: Spark-native ingestion and operations analytics.

Sub-packages:
  functions/  Column -> Column scalar helpers (parsing, formatting, patterns)
  sources/    readers for landed files and API payloads
  operators/  DataFrame -> DataFrame operators (projections, joins, aggregates,
              datasets, calendar, feeds, artwork, quality, sinks)
  plans/      the registered queries over the driver tables + their SQL oracles
  streaming/  Structured Streaming versions of the import / event jobs
"""

from kiln.session import get_session, staging_dir

__all__ = ["get_session", "staging_dir"]
