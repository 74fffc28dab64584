"""Training-data operators: PII, secrets, joins, decontamination, URL rules, language ID,
HTML extraction, packing, line dedup and order-sensitive fingerprints."""
