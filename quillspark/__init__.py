"""quillspark: document retrieval, masking and text analytics as Spark plans."""
