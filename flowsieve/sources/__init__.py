"""Readers and writers: CSV, ARFF, capture files, prediction stores."""
