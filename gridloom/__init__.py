"""gridloom: a PySpark-native engine for point-in-time panel analytics.

Everything is a lazy DataFrame plan over long tables; Python runs only in Arrow batches where linear algebra or
ordered state needs it.
"""

__version__ = "0.1.0"
