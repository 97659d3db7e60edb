"""Lotwright: an analytics engine for asset listings and text corpora, written for Spark."""
