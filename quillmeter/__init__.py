"""Usage, cost and activity analytics over newline-delimited JSON session transcripts, on Spark."""
