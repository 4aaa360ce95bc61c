"""Corpus operators for large training-data pipelines.

Nothing outside this package (and the pipeline file at the top of the
repository) imports it.  Ship the package to the executors with
``--py-files`` or by installing it; the Python functions here are pickled
by reference.
"""
