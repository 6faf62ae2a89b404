"""Training-data operators: packing, deduplication, filtering, mixing, WARC, secrets.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
