"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries`` registers one query
per operator; each operator module keeps its own general interface.
"""
