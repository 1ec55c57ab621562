"""slotwise: job-history analytics on Spark.

Reports over nested job records (one row per job, with its usage timeline and
query-plan stages inside the row) written with built-in DataFrame operators:
``slotwise.plans.reports`` holds the reports, ``slotwise.operators`` the
reusable operators, ``slotwise.sources`` the readers.
"""

__version__ = "0.1.0"
