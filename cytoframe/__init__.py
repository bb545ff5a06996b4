"""Tumour/normal sequencing analytics and table preparation on PySpark DataFrames."""
