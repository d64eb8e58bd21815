"""Training-data operators: quality, media, PII, packing, licences, near-duplicates, HTML, language model, tokens.

Nothing outside this subpackage (and ``corpus_pipeline``) imports it.
"""
