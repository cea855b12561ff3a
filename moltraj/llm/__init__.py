"""Operators for large text corpora: quality, tokens, pages, toxicity, duplicates, personal data, packing.

Each module holds one operator with its general interface and the registered query `opN_<name>` that applies it to a
whole table. Worker functions are imported by the executors, so ship the package with the job (`--py-files`).
"""
