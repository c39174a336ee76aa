"""Training-data operators: search, de-duplication, archives, packing, mixing, sharding.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
