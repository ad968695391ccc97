"""assayframe: Spark-first analytics over longitudinal measurements from many providers."""
