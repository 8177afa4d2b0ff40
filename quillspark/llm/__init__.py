"""Training-data operators: scoring, sharding, archives, decontamination, mixing,
fingerprints, secret scans, language identification, chat formatting and near-dedup.
Nothing else in the library imports this subpackage."""
