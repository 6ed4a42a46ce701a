"""Operators for preparing training text at cluster scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; Python runs only in ``mapInArrow`` over bounded slices of a batch.
"""
