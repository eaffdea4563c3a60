"""Operations of a training-data pipeline: tokens, fingerprints, duplicates, contamination, shards, quality, language.

Every operator takes a frame with an id and a text column (names are parameters), reads no other column and so
accepts any further ones.  Nulls count as empty texts unless an operator says otherwise.
"""
