"""Spark operators for corpora of recorded two-channel conversations and the scores computed on them."""
