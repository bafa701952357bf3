"""Operators for training data: runs, percentiles, splitting, top items, token ids, packing and cut-off texts."""
