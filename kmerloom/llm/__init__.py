"""Training-data operators: extraction, classification, de-duplication, search, tokens and sharding.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
