"""Training-data operators (PII, filters, archives, classifiers, tokenizing, dedup, media, HTML).

Nothing else in the library imports this subpackage; `registry` lists its queries.
"""
