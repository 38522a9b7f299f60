"""cohortlens: customer-loyalty analytics as Spark DataFrame operators.

Typical use::

    from cohortlens.plans.pipeline import Study
    from cohortlens.operators import segments

    study = Study(spark, tables)            # tables: a sources.Snowflake
    report = segments.segment_return(study.profile_f, "first_event_type")
"""

__version__ = "0.1.0"
