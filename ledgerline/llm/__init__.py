"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it;
``__spark_entry__.py`` adds its queries only when it is present.
"""
