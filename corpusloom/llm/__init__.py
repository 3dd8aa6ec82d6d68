"""Operators for large-scale training-data preparation.

Nothing else in the library imports this package.  ``queries`` holds the thin
``opN_<name>`` queries over the driver's tables; every other module is a
general operator.
"""
