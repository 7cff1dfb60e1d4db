"""Operations of a training-data pipeline: sharding, scoring, near-duplicates, scans, tokens."""
