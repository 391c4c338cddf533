"""Operators of a training-data pipeline: search, mixing, archives, language, duplicates,
sharding, quality, language-model scores, decontamination and quoted conversations."""
