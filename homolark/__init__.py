"""homolark: sequence-similarity analytics and training-data operators on PySpark."""
