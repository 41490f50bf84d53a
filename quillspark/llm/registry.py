"""All queries of this folder and their SQL."""

from . import bit_codes, bpe, cotraining, fill_middle, hypervectors, packing, parity_join, pii_crf, rule_forest, shards, token_files, url_rules, yinyang

MODULES = [cotraining, shards, rule_forest, bit_codes, hypervectors, packing, parity_join, bpe, url_rules, pii_crf, token_files, yinyang, fill_middle]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
