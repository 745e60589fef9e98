"""stackrank: multi-target scoring analytics expressed as Spark DataFrame plans.

Layout
------
functions/  column expressions shared by every operator (hashing, safe maths)
sources/    scans and sinks: driver tables, the entity mart, prediction sources,
            JSON / CSV reports and the run log
operators/  the table operators (folds, samples, encoders, profiles, metrics,
            ranking, blending, routing, audit, trials, reports, MLlib models)
plans/      named queries wired from operators, with their DuckDB oracle SQL
streaming/  file-stream scoring of prediction outputs as they land
"""

from stackrank.session import get_spark

__all__ = ["get_spark"]
