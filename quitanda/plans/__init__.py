"""Named results, export rules and the batch job."""
