"""Operators of a training-data pipeline over `documents`, `embeddings`, `benchmark` and `labels`.

Nothing outside this folder imports it, apart from the guarded import of `__spark_entry__.py`.
"""
