"""Distributed building blocks: binning, histograms, splits, sampling, statistics."""
