"""curul: Spark jobs that reconcile, audit and search public legislative records."""
