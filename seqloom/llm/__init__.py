"""Operators for training-data corpora: tables of documents (doc_id, text, lang, source, ...)."""
