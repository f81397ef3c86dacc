"""Quality checks for event-level vaccination records, as Spark DataFrame jobs.

* ``functions``  column expressions (dates, rounding, labels)
* ``sources``    schemas, readers, writers
* ``operators``  DataFrame -> DataFrame steps
* ``plans``      whole jobs: design, extraction, reports, set-intersection counts
* ``study``      dates, campaigns, product names, approvals: every constant a job reads
"""
