"""Readers that turn files, checkpoints and stores into DataFrames."""
