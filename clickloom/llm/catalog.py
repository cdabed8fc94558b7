"""All queries of this subpackage, with their SQL where SQL can express them."""

from clickloom.llm import decontaminate, exact_dedup, html, ngram_join, ngram_lm, packing, secrets, spelling, substrings, toxicity, warc, wavelet, whitening

_modules = [packing, decontaminate, html, exact_dedup, toxicity, substrings, ngram_join, wavelet, secrets, ngram_lm, whitening, warc, spelling]
QUERIES = {name: q for m in _modules for name, (q, _) in m.QUERIES.items()}
ORACLES = {name: sql for m in _modules for name, (_, sql) in m.QUERIES.items() if sql}
