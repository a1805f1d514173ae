"""Operators for preparing language-model training corpora.

One module per operator, ``catalog`` with the registered queries. Nothing
outside this subpackage imports it.
"""
