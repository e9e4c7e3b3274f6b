"""Operators of a training-data pipeline: tokenizers, search, scans, near-duplicates,
packing, language-model scores and quality rules over tables of documents and vectors."""
