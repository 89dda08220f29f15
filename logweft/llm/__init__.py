"""Operators for preparing training text at cluster scale.

Nothing else in the library imports this subpackage. Each module holds one operator; ``queries`` registers one
query per operator over the ``documents`` (or ``pages``) table.
"""
