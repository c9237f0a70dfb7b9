"""Preparation of training text: duplicates, secrets, language, scoring, packing and output, each as Spark jobs over whole texts."""
