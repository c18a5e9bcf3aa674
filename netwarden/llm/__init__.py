"""Training-data operators: corpus-preparation steps as Spark jobs.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
