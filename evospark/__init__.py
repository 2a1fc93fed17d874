"""PySpark-native analytics for directed-evolution campaigns.

Every public function takes DataFrames and returns a DataFrame, so the
operators compose into one lazy plan that Catalyst optimises as a whole.
"""

__version__ = "0.1.0"
