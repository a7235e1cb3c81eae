"""Readers and writers of training data, run folders and result files."""
