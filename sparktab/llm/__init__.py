"""Operations of a large training-data pipeline.

Ten operators, one module each, and ``queries`` which applies each of them to its whole
table.  Nothing outside this package imports it except ``__spark_entry__.py`` (guarded)
and ``corpus_pipeline.py``.
"""
