"""Operators for training-data pipelines. Nothing else in homolark imports this subpackage."""
