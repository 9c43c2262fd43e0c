"""Operators for preparing large text corpora as training data.

Every operator takes and returns DataFrames; the modules share ``runtime`` only.
Nothing outside this subpackage imports it.
"""
