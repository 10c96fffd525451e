"""Training-data operators: dedup, decontamination, filtering, mixing and token output.

Nothing outside this subpackage imports it.
"""
