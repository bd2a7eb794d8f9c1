"""Plans that belong to the engine itself: pseudonyms, shards, catalog."""
