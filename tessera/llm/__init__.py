"""Training-data operators.

Nothing else in the library imports this subpackage; the entry module adds its
queries only if the subpackage is there.
"""
