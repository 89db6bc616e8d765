"""Operators for building training corpora, one module each.

Nothing outside this subpackage imports it; `queries()` and `oracle_sql()` in
`registry` list what the driver contract runs.
"""
