"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Each operator module has a general
interface; `queries` binds the operators to the driver's tables.
"""
