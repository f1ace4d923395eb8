"""Training-data operators over the ``documents`` family of tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
