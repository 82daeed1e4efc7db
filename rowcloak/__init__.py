"""rowcloak: relational slicing, masking and leak scanning as Spark DataFrame jobs."""
