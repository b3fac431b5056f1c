"""Training-corpus operators: one module for each, and their registered queries in ``queries``.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
