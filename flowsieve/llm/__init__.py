"""Operations of a training-data pipeline: cleaning, deduplication, packing, sharding, encoding, scoring."""
