"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; `catalog.queries()` lists what it registers.
"""
