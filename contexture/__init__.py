"""Put events into context with Spark.

Observations (a condition that held at an instant) and incidents (something
that happened at an instant) are normalised, de-duplicated and joined on event
time; rate, severity and history marts are computed on the result.
"""

__version__ = "0.1.0"
