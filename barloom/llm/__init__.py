"""Training-data operators on DataFrames: one module an operator, ``queries`` for their registered queries.

Nothing outside this subpackage imports it.
"""
