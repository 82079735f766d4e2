"""tapeline: batches of transcribed media and training-data text, as Spark DataFrame jobs."""
