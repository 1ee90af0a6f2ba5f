"""tidewatch: match a tide of text events against saved interests, on Spark.

``functions``  Column expressions (no jobs, no state)
``sources``    feeds, filings, dimension and registry readers
``operators``  DataFrame -> DataFrame operators: joins, scoring, ranking, tables
``plans``      operators wired into whole queries, plus their table bindings
``streaming``  the same operators under Structured Streaming
"""
