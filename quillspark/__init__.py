"""quillspark: documentation retrieval and repository analytics as plain PySpark DataFrame jobs."""
