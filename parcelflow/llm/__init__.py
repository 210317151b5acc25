"""Training-data operators. Nothing outside this sub-package imports it.

Conventions shared by all modules:

* a *word* is a maximal run of characters other than U+0020 and U+0009..U+000D;
* a null text counts as an empty one unless an operator says otherwise;
* tables read by a query are only read through Spark's readers, and whatever must
  outlive a task is written with Spark's writers below ``spark.checkpoint.dir``.
"""
