"""kerbline: a PySpark-native engine for inventorying, profiling and curating recorded sequences.

The subpackages follow the life of a query: ``sources`` read, ``functions`` are Column-in/Column-out
scalars, ``operators`` are DataFrame-in/DataFrame-out relational operators, ``plans`` composes them into
named queries, ``streaming`` holds the incremental variants.
"""

__version__ = "0.1.0"
