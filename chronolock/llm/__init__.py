"""Operations of a training-data pipeline: corpus cleaning, fingerprints, packing and archives.

Nothing outside this package imports it.  ``registry`` holds the queries.
"""
