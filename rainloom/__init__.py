"""Station time-series preparation, gap filling, forecasting and scoring on Spark.

Every operator is a ``DataFrame -> DataFrame`` function or a ``Column``
expression.  The common input is the long series table
``(station, date, value)``; see ``README.md`` for the layout.
"""
