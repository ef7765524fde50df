"""Operators of a training-data pipeline over the ``documents``, ``pages``, ``labels`` and ``benchmark`` tables.

Nothing else in the package imports this subpackage.
"""
