"""Readers and writers of features and archives."""
