"""skiff: move compressed line files into analysis-ready form on Spark.

Four families, each a set of DataFrame -> DataFrame functions:

* catalogue  (``skiff.operators.catalog``)   listing roll-ups
* select     (``skiff.operators.select``)    selection -> de-duplicated file set
* transport  (``skiff.operators.transport``) decompress, normalise, shard, write
* runs       (``skiff.operators.runs``)      run history folded from events
"""

__version__ = "0.1.0"
