"""Training-data operators: ten Spark jobs over whole document tables.

Each module holds one operator with its own interface; ``queries`` derives the
contract columns from them.  Nothing outside this subpackage imports it.
"""
