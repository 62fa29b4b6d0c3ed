"""Operators for preparing language-model training text at scale.

Nothing outside this folder imports it: the rest of the library works, and is
tested, without it.
"""
