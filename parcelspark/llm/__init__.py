"""Training-data operators: each module holds one operator over plain DataFrames.

Nothing else in the library imports this subpackage; it imports only the
general helpers of ``parcelspark.session``.
"""
