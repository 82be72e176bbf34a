"""Training-data operators: fingerprints, near-dedup, licences, capture index, packing,
language ID, PII, chat formatting, decontamination and quality. Nothing else in the package
imports this subpackage."""
