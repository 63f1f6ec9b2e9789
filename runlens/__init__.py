"""runlens: Spark-native analytics for test-generation runs and chat-formatted training text.

Every operator is a DataFrame -> DataFrame function built on Spark's own joins,
aggregates, windows, higher-order functions and Structured Streaming.
"""

__version__ = "0.1.0"
