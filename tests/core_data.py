"""Data folder that the core tests read."""

SMALL = "/root/testdata/sf0.001"
