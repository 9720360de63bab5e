"""Operators for preparing training data at corpus scale.

Every operator is a ``DataFrame -> DataFrame`` function with its own general
interface; ``queries.py`` applies each to its whole test table and registers
the result.  Nothing outside this folder (and ``corpus_pipeline.py``, which
counts as part of it) imports these modules.
"""
