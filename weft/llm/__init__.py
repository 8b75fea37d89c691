"""Training-data operators and their queries (one module per operator).

Nothing else in the library imports this subpackage; ``__spark_entry__``
adds :mod:`weft.llm.queries` when it is present.
"""
