"""DataFrame -> DataFrame operators of the study (usable with ``df.transform``)."""
