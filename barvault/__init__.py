"""barvault: a market-data warehouse written as PySpark DataFrame operators.

Subpackages
-----------
functions   column expressions (text, clock, prices)
operators   DataFrame -> DataFrame operators (views, search, lookups, as-of, ranges, chart, ledger, audit)
sources     landed responses, the candle archive and the warehouse catalogue
plans       compositions: list load, save / update of series, chart frame, adapters for star-schema tables
streaming   incremental candle ingest
"""
