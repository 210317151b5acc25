"""parcelflow: relational, raster and proposal analytics on Spark DataFrames.

Sub-packages: ``sources`` (tables and adapters), ``functions`` (column builders),
``operators`` (DataFrame -> DataFrame operators), ``plans`` (registered queries with
their SQL), ``streaming`` (extensions over event streams) and ``llm`` (training-data
operators; nothing else here imports it).
"""
