"""Training-data pipeline operators: packing, near-dedup, line dedup, mixing,
n-gram joins, toxicity, licence scans, token files, WARC and nearest neighbours.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; its
registered queries live in ``llm.queries``.
"""
