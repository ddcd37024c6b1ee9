"""veilspark: private table analytics as declarative Spark plans."""
