"""Training-data operators: scoring, cleaning, deduplication and packing of text corpora.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; intermediate results that are read twice are written as
Parquet under the folder that ``spark.checkpoint.dir`` names, so that the loss
of an executor costs a task retry and never a result.
"""
