"""The complete analytics: one function each, from a posts table to the rows a chart or table shows.

The posts are expected to be normalised (``sources.posts.normalise_posts``): clean text and
``created_at`` a date. Each function selects the columns it reads before anything else.
"""
