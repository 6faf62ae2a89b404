"""tillroll: retail / HR / cost analytics as Spark DataFrame operators.

Layout
------
sources/    reading the driver tables and binding them to the analytic shapes
functions/  column-level helpers (month keys, exact rounding, safe division)
operators/  pure ``DataFrame -> DataFrame`` analytic operators
plans/      the named queries (keys of ``__spark_entry__.queries``) and oracle SQL
streaming/  the same operators driven by Structured Streaming micro-batches
"""

from tillroll.session import get_session

__all__ = ["get_session"]
