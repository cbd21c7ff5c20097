"""Operations of a training-data pipeline: deduplication, privacy, packing, archives, sharding, scoring."""
