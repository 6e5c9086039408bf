"""postweave: analytics over tables of short posts, written as Spark DataFrame jobs.

``sources``    read and write posts, lexicons and stop words
``functions``  column expressions (cleaning, tokens, calendar, labels)
``operators``  DataFrame to DataFrame steps (tokens, joins, counts, ranking, statistics, topics)
``plans``      the complete analytics, one function each
"""
