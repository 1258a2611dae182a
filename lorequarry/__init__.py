"""Study analytics on Spark: text structuring, grading, scheduling and question banks."""
