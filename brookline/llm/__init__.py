"""Operators for preparing large text corpora as model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, names its columns by parameter and keeps its own internal columns
under the prefix ``_bl_`` so that extra input columns never clash.
"""
