"""tidespine: point-in-time features, labels and evaluation on Spark DataFrames.

Every operator takes and returns DataFrames and is planned by Catalyst. The common currency is the
*spine*: one row per (entity, day) that features are attached to without ever looking ahead.
"""
