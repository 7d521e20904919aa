"""Readers: files of images and text, pairs, dictionaries, rules, benchmark data and layouts."""
