"""Operators for training-data work: archives, cleaning, duplicates, classifiers, tokens and packing."""
