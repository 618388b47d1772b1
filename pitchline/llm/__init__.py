"""Training-data operators: one module each, all on DataFrames.

``queries`` registers them; nothing outside this subpackage imports it.
"""
