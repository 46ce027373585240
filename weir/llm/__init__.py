"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing else in the library imports this subpackage; ``queries.py`` registers
its queries with ``__spark_entry__.py`` when the subpackage is present.
"""
