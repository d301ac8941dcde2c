"""Commerce diagnostics expressed as Spark DataFrame jobs.

``sources``    reading, writing, canonical tables
``functions``  column-level helpers and p-values
``operators``  reusable DataFrame -> DataFrame operators
``plans``      topic reports composed from the operators
"""
