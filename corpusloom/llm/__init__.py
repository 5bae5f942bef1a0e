"""Operators for training-data pipelines.

Nothing outside this subpackage imports it.  ``queries.py`` binds the operators
to the driver's tables; every operator itself takes and returns DataFrames and
lets the caller name the columns it reads.

Conventions shared by all operators:

* a null text is an empty text, a null id is kept as a row of its own;
* only the id and the named inputs are read, so further columns of the input,
  whatever their names, never clash with an output;
* repeated rows are rows: nothing is deduplicated unless that is the feature;
* an empty input gives an empty result with the documented schema.
"""
