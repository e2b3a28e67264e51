"""Whole jobs: take a snapshot, restore from one, run the log archive once."""
