"""Training-data operators: filters, near-duplicates, search, mixing, packing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
