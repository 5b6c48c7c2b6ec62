"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage.  ``queries`` holds the
registered queries and their SQL; every operator lives in a module of its own.
"""
