"""Training-data operators: packing, language id, quality rules, archives, token files, dedup, joins, sharding, BPE."""
