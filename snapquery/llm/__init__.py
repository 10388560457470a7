"""Training-data operators: ten self-contained operators over document and vector tables.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``queries`` holds the thin registered queries built on them.
"""
